"""The causal residual network: parameters, forward pass and gradients of one read, in NumPy.

Spark deals reads to tasks; each task runs this on its own reads (plans/infer.py,
plans/training.py). Attention is banded, so a read of L symbols costs L * context.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np

from qualweave.constants import ALPHABET, CLASSES, CONTEXT, CONTINUOUS, Q_KS, Q_TOKENS, R_KS, R_TOKENS, SHIFT, VOCAB
from qualweave.errors import SequenceError

LAYER_EPS = 1e-5
MASKED = -1e9
#: Queries handled together; a block sees itself and context - 1 places before it.
QUERY_BLOCK = 128


@dataclass
class Config:
    q_hat_dim: int = 16
    prev_q_dim: int = 16
    prev_r_dim: int = 32
    q_ks: tuple[int, ...] = Q_KS
    r_ks: tuple[int, ...] = R_KS
    q_vocab: int = VOCAB
    r_vocab: int = VOCAB
    q_mer_dim: int = 8
    r_mer_dim: int = 8
    d_model: int = 256
    heads: int = 4
    layers: int = 2
    feedforward: int = 512
    context: int = CONTEXT
    stride: int = 1

    def __post_init__(self) -> None:
        self.q_ks, self.r_ks = tuple(self.q_ks), tuple(self.r_ks)
        if self.layers < 1:
            raise SequenceError("layers must be at least 1")
        if self.d_model <= 0 or self.heads <= 0 or self.d_model % self.heads:
            raise SequenceError("d_model must be positive and divisible by heads")
        if self.feedforward <= 0 or self.context <= 0:
            raise SequenceError("feedforward and context must be positive")

    @property
    def width(self) -> int:
        return CONTINUOUS + self.q_hat_dim + self.prev_q_dim + self.prev_r_dim + len(self.q_ks) * self.q_mer_dim + len(self.r_ks) * self.r_mer_dim

    def embeddings(self) -> list[tuple[str, int, int]]:
        """name, rows, columns in the order of the input."""
        mers = [(f"q_mer_{i}", self.q_vocab, self.q_mer_dim) for i in range(len(self.q_ks))] + [(f"r_mer_{i}", self.r_vocab, self.r_mer_dim) for i in range(len(self.r_ks))]
        return [("q_hat", ALPHABET, self.q_hat_dim), ("prev_q", Q_TOKENS, self.prev_q_dim), ("prev_r", R_TOKENS, self.prev_r_dim), *mers]


Parameters = dict[str, np.ndarray]


def create(config: Config, seed: int) -> Parameters:
    """Seeded parameters: normal embeddings, uniform weights within the root of the fan-in, unit norms."""
    rng = np.random.default_rng(seed)
    d, ff = config.d_model, config.feedforward
    p: Parameters = {f"emb.{n}": rng.normal(size=(rows, cols)) for n, rows, cols in config.embeddings()}

    def linear(name: str, fan_in: int, fan_out: int) -> None:
        bound = 1 / math.sqrt(fan_in)
        p[f"{name}.w"] = rng.uniform(-bound, bound, (fan_in, fan_out))
        p[f"{name}.b"] = rng.uniform(-bound, bound, fan_out)

    linear("in", config.width, d)
    for k in range(config.layers):
        linear(f"{k}.qkv", d, 3 * d)
        linear(f"{k}.out", d, d)
        linear(f"{k}.up", d, ff)
        linear(f"{k}.down", ff, d)
        for n in ("norm1", "norm2"):
            p[f"{k}.{n}.w"], p[f"{k}.{n}.b"] = np.ones(d), np.zeros(d)
    p["norm.w"], p["norm.b"] = np.ones(d), np.zeros(d)
    linear("head", d, CLASSES)
    return p


def encoding(length: int, d: int) -> np.ndarray:
    """Sine in even columns, cosine in odd ones; d may be odd."""
    angle = np.arange(length)[:, None] * np.exp(np.arange(0, d, 2) * (-math.log(10_000.0) / d))
    out = np.zeros((length, d))
    out[:, 0::2] = np.sin(angle)
    out[:, 1::2] = np.cos(angle[:, : d // 2])
    return out


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact GELU and its derivative."""
    cdf = 0.5 * (1 + _erf(x / math.sqrt(2)))
    return x * cdf, cdf + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    mean = x.mean(axis=1, keepdims=True)
    scale = 1 / np.sqrt(((x - mean) ** 2).mean(axis=1, keepdims=True) + LAYER_EPS)
    y = (x - mean) * scale
    return y * w + b, (y, scale)


def norm_back(g: np.ndarray, kept: tuple, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, scale = kept
    h = g * w
    return scale * (h - h.mean(axis=1, keepdims=True) - y * (h * y).mean(axis=1, keepdims=True)), (g * y).sum(axis=0), g.sum(axis=0)


def bands(length: int, context: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Query rows, the key rows they may see, and which of those each query doesn't see."""
    for a in range(0, length, QUERY_BLOCK):
        q, k = slice(a, min(a + QUERY_BLOCK, length)), slice(max(0, a - context + 1), min(a + QUERY_BLOCK, length))
        far = np.arange(q.start, q.stop)[:, None] - np.arange(k.start, k.stop)
        yield q, k, (far < 0) | (far >= context)


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, context: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """q, k, v: heads, length, size. The output, and the attention of each band."""
    out, kept = np.empty_like(q), []
    for rows, cols, hidden in bands(q.shape[1], context):
        s = q[:, rows] @ k[:, cols].transpose(0, 2, 1) / math.sqrt(q.shape[2])
        s[:, hidden] = -np.inf
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        out[:, rows] = s @ v[:, cols]
        kept.append(s)
    return out, kept


def _heads(x: np.ndarray, n: int) -> np.ndarray:
    return x.reshape(len(x), n, -1).transpose(1, 0, 2)


def _joined(x: np.ndarray) -> np.ndarray:
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


@dataclass
class Read:
    """One read's inputs. tokens: one column for each embedding, in the order of Config.embeddings()."""

    continuous: np.ndarray
    tokens: np.ndarray
    targets: np.ndarray


def forward(config: Config, p: Parameters, read: Read) -> tuple[np.ndarray, dict]:
    """Logits, and what the backward pass needs."""
    length = len(read.targets)
    if length < 1 or read.continuous.shape != (length, CONTINUOUS) or read.tokens.shape != (length, len(config.embeddings())):
        raise SequenceError("a read needs at least one symbol and all its features")
    parts = [read.continuous, *(p[f"emb.{n}"][read.tokens[:, i]] for i, (n, *_) in enumerate(config.embeddings()))]
    joined = np.concatenate(parts, axis=1)
    pre = joined @ p["in.w"] + p["in.b"]
    x = np.maximum(pre, 0) + encoding(length, config.d_model)
    kept: dict = {"joined": joined, "pre": pre, "layers": []}
    for k in range(config.layers):
        a, n1 = norm(x, p[f"{k}.norm1.w"], p[f"{k}.norm1.b"])
        q, key, v = (_heads(t, config.heads) for t in np.split(a @ p[f"{k}.qkv.w"] + p[f"{k}.qkv.b"], 3, axis=1))
        o, attention = attend(q, key, v, config.context)
        o = _joined(o)
        x = x + o @ p[f"{k}.out.w"] + p[f"{k}.out.b"]
        b, n2 = norm(x, p[f"{k}.norm2.w"], p[f"{k}.norm2.b"])
        up, slope = gelu(b @ p[f"{k}.up.w"] + p[f"{k}.up.b"])
        x = x + up @ p[f"{k}.down.w"] + p[f"{k}.down.b"]
        kept["layers"].append((a, n1, q, key, v, attention, o, b, n2, up, slope))
    y, last = norm(x, p["norm.w"], p["norm.b"])
    kept |= {"y": y, "last": last}
    return y @ p["head.w"] + p["head.b"], kept


def log_softmax(logits: np.ndarray, q_hat: np.ndarray) -> np.ndarray:
    """Over the 189 residual classes, those that lead out of the alphabet masked."""
    quality = q_hat[:, None] + np.arange(CLASSES) - SHIFT
    x = np.where((quality >= 0) & (quality < ALPHABET), logits, MASKED)
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def loss_and_gradients(config: Config, p: Parameters, read: Read) -> tuple[float, Parameters]:
    """Summed cross-entropy in nats of one read, and its gradients."""
    logits, kept = forward(config, p, read)
    logp = log_softmax(logits, read.tokens[:, 0])
    rows = np.arange(len(read.targets))
    loss = -float(logp[rows, read.targets].sum())
    g = np.exp(logp)
    g[rows, read.targets] -= 1
    out: Parameters = {"head.w": kept["y"].T @ g, "head.b": g.sum(axis=0)}
    g, out["norm.w"], out["norm.b"] = norm_back(g @ p["head.w"].T, kept["last"], p["norm.w"])
    size = math.sqrt(config.d_model / config.heads)
    for k in range(config.layers - 1, -1, -1):
        a, n1, q, key, v, attention, o, b, n2, up, slope = kept["layers"][k]
        out[f"{k}.down.w"], out[f"{k}.down.b"] = up.T @ g, g.sum(axis=0)
        h = (g @ p[f"{k}.down.w"].T) * slope
        out[f"{k}.up.w"], out[f"{k}.up.b"] = b.T @ h, h.sum(axis=0)
        h, out[f"{k}.norm2.w"], out[f"{k}.norm2.b"] = norm_back(h @ p[f"{k}.up.w"].T, n2, p[f"{k}.norm2.w"])
        g = g + h
        out[f"{k}.out.w"], out[f"{k}.out.b"] = o.T @ g, g.sum(axis=0)
        h = _heads(g @ p[f"{k}.out.w"].T, config.heads)
        dq, dk, dv = np.zeros_like(q), np.zeros_like(key), np.zeros_like(v)
        for (rs, cs, _), s in zip(bands(q.shape[1], config.context), attention, strict=True):
            dv[:, cs] += s.transpose(0, 2, 1) @ h[:, rs]
            ds = h[:, rs] @ v[:, cs].transpose(0, 2, 1)
            ds = s * (ds - (ds * s).sum(axis=2, keepdims=True)) / size
            dq[:, rs] += ds @ key[:, cs]
            dk[:, cs] += ds.transpose(0, 2, 1) @ q[:, rs]
        h = np.concatenate([_joined(dq), _joined(dk), _joined(dv)], axis=1)
        out[f"{k}.qkv.w"], out[f"{k}.qkv.b"] = a.T @ h, h.sum(axis=0)
        h, out[f"{k}.norm1.w"], out[f"{k}.norm1.b"] = norm_back(h @ p[f"{k}.qkv.w"].T, n1, p[f"{k}.norm1.w"])
        g = g + h
    g = g * (kept["pre"] > 0)
    out["in.w"], out["in.b"] = kept["joined"].T @ g, g.sum(axis=0)
    g, at = g @ p["in.w"].T, CONTINUOUS
    for i, (n, size_, cols) in enumerate(config.embeddings()):
        out[f"emb.{n}"] = np.zeros((size_, cols))
        np.add.at(out[f"emb.{n}"], read.tokens[:, i], g[:, at : at + cols])
        at += cols
    return loss, out


def save(path: str | Path, config: Config, p: Parameters, epoch: int, metrics: dict, optimizer: Parameters | None = None) -> None:
    """config.json beside weights.npz; the optimizer's state goes with the weights."""
    path = Path(path)
    path.mkdir(parents=True, exist_ok=True)
    (path / "config.json").write_text(json.dumps({"config": asdict(config), "epoch": epoch, "val_metrics": metrics}, indent=2) + "\n", encoding="utf-8")
    np.savez(path / "weights.npz", **p, **{f"opt/{k}": v for k, v in (optimizer or {}).items()})


def load(path: str | Path) -> tuple[Config, Parameters, dict]:
    """Without window lengths in the config there are none, as in early checkpoints."""
    path = Path(path)
    info = json.loads((path / "config.json").read_text(encoding="utf-8"))
    config = Config(**{"q_ks": (), "r_ks": ()} | info["config"])
    with np.load(path / "weights.npz") as z:
        p = {k: z[k] for k in z.files if not k.startswith("opt/")}
    return config, p, info
