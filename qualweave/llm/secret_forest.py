"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters with a digit, values assigned to names
such as token or password, and private key blocks. Each is described by its length,
its character transitions (changes of class, and how likely its letter pairs are in
words), the part of it that dictionary words cover, signs of a path, and the words
before and after it. A random forest of Spark ML, trained on labelled findings,
tells secrets from digests, identifiers, numbers, addresses and plain words.

The labelled findings come with the module as a generator of examples (kinds and
contexts below, random values); scan takes any other labelled findings instead. The
dictionary is the vocabulary of a public tokenizer, a file whose path is a parameter.

Defined cases: null text is empty and has no candidates; very long texts are scanned
whole; rows that repeat an id report each; a null id is reported as null; labels of
one class only make every score that class; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualweave.llm.sentencepiece_lattice import MODEL, load

TREES, DEPTH, SEED = 40, 8, 11
EXAMPLES = 4_000
THRESHOLD = 0.5
CONTEXT = 48
#: Names whose assigned values are candidates, and words beside harmless ones.
SECRET_NAMES = "token secret password passwd pwd passphrase credential credentials apikey api_key api-key access_key accesskey auth_token authorization bearer private_key client_secret signing_key".split()
HARMLESS_NAMES = "commit sha sha1 sha256 md5 checksum digest hash etag uuid guid id ref revision version build color phone tel call order invoice isbn card account page url href src email mail".split()
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?"
    rf"|(?i:\b(?:{'|'.join(map(re.escape, SECRET_NAMES))})\b[\"']?\s*(?:[:=]|=>|:=)\s*[\"']?)(?P<value>[^\s\"']{{6,}})"
    r"|(?<![A-Za-z0-9+/_=.@~-])(?=[A-Za-z+/_=.@~-]*[0-9])[A-Za-z0-9+/_=.@~-]{16,}"
)
FEATURES = (
    "length distinct digits uppers lowers others hex_only entropy changes letter_pairs coverage longest_word slashes dots at_sign path_before "
    "assigned quoted secret_before harmless_before secret_after harmless_after words_before pem".split()
)
_CLASS = np.zeros(128, np.int8)
for _k, _chars in enumerate((string.digits, string.ascii_uppercase, string.ascii_lowercase), 1):
    _CLASS[[ord(c) for c in _chars]] = _k


class Describer:
    """Features of a candidate in its text. dictionary: lower-case words."""

    def __init__(self, dictionary: list[str]) -> None:
        self.words = frozenset(w for w in dictionary if 3 <= len(w) <= 14)
        counts = np.ones((27, 27))
        for w in self.words:
            codes = [0, *(ord(c) - 96 for c in w), 0]
            for a, b in zip(codes[:-1], codes[1:], strict=True):
                counts[a, b] += 1
        self.pairs = np.log2(counts / counts.sum(axis=1, keepdims=True) * 27)

    def _coverage(self, s: str) -> tuple[float, int]:
        low, at, covered, longest = s.lower(), 0, 0, 0
        while at < len(low):
            n = next((n for n in range(min(14, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            covered, longest, at = covered + n, max(longest, n), at + max(n, 1)
        return covered / max(len(low), 1), longest

    def __call__(self, text: str, start: int, end: int) -> list[float]:
        s = text[start:end]
        code = np.array([min(ord(c), 127) for c in s])
        kind = _CLASS[code]
        share = np.bincount(kind, minlength=4)[:4] / len(s)
        p = np.bincount(code) / len(s)
        p = p[p > 0]
        letters = re.findall(r"[a-z]+", s.lower())
        codes = [[0, *(ord(c) - 96 for c in w), 0] for w in letters]
        pair = [self.pairs[a, b] for w in codes for a, b in zip(w[:-1], w[1:], strict=True)]
        coverage, longest = self._coverage(s)
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        near = re.findall(r"[A-Za-z_-]+[0-9]*", before.lower())[-4:]
        far = re.findall(r"[A-Za-z_-]+[0-9]*", after.lower())[:3]
        said = lambda ws, names: float(any(w.strip("_-") in names for w in ws))
        return [
            float(len(s)),
            len(set(s)) / len(s),
            float(share[1]),
            float(share[2]),
            float(share[3]),
            float(share[0]),
            float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
            float(-(p * np.log2(p)).sum()),
            float((kind[1:] != kind[:-1]).mean()) if len(kind) > 1 else 0.0,
            float(np.mean(pair)) if pair else -5.0,
            coverage,
            float(longest),
            float(s.count("/") + s.count("\\")),
            float(s.count(".")),
            float("@" in s),
            float(bool(re.search(r"(?:[A-Za-z]:|\.{0,2})[/\\][\w./\\-]*$", before))),
            float(bool(re.search(r"(?:[:=]|=>)\s*[\"']?$", before))),
            float(before[-1:] in "\"'`" and before != ""),
            said(near, SECRET_SET),
            said(near, HARMLESS_SET),
            said(far, SECRET_SET),
            said(far, HARMLESS_SET),
            float(len(near)),
            float(s.startswith("-----BEGIN")),
        ]


SECRET_SET, HARMLESS_SET = frozenset(SECRET_NAMES), frozenset(HARMLESS_NAMES)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        start, end = m.span("value") if m["value"] is not None else m.span()
        s = text[start:end].rstrip(".,;:)]}!?")
        if s:
            yield start, start + len(s)


@lru_cache(maxsize=2)
def dictionary(model: str = MODEL) -> tuple[str, ...]:
    return tuple(sorted({p.strip().lower() for p in load(model).ids if re.fullmatch(r" ?[A-Za-z]{3,14}", p)}))


def examples(n: int = EXAMPLES, seed: int = SEED, words: tuple[str, ...] = ()) -> list[tuple[str, int, int, int]]:
    """Labelled findings: text, start, end, secret (0 or 1). Half of them are false positives."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    base = words or dictionary()
    prose = lambda k: " ".join(rng.choice(base) for _ in range(k))
    b64, alnum, hexes = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef"
    values = {
        1: [
            lambda: pick(hexes, rng.choice((32, 40, 48, 64))),
            lambda: pick(alnum, rng.randrange(20, 48)),
            lambda: pick(b64, rng.randrange(24, 64)) + rng.choice(("", "=", "==")),
            lambda: rng.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + string.digits, 16),
            lambda: rng.choice(("ghp_", "gho_", "sk-", "xoxb-", "glpat-")) + pick(alnum, rng.randrange(24, 40)),
            lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 30),
            lambda: pick(alnum + "!#$%&*", rng.randrange(10, 20)),
        ],
        0: [
            lambda: pick(hexes, 40),
            lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
            lambda: pick(string.digits, rng.randrange(16, 20)),
            lambda: f"{rng.choice(base)}.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com",
            lambda: "/".join(rng.choice(base) for _ in range(rng.randrange(2, 5))) + f"/{rng.choice(base)}{rng.randrange(100)}.txt",
            lambda: "_".join(rng.choice(base) for _ in range(rng.randrange(2, 5))) + str(rng.randrange(100)),
            lambda: "".join(rng.choice(base).title() for _ in range(3)) + str(rng.randrange(100)),
            lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}T0{rng.randrange(10)}:00",
            lambda: rng.choice(("your_", "my_", "example_")) + rng.choice(base) + rng.choice(("_here", "_placeholder_1", "_token_0", "_xxxxxxxx")),
            lambda: pick("x0*", 1) * rng.randrange(16, 40),
            lambda: rng.choice(base) * 3 + pick("!&%$#*", 3),
        ],
    }
    out = []
    for k in range(n):
        secret = k % 2
        kind = rng.randrange(len(values[secret]))
        value, lead, tail = values[secret][kind](), prose(rng.randrange(0, 6)), prose(rng.randrange(0, 6))
        quote = rng.choice(("", '"', '"', "'"))
        if secret:
            lead += " " + rng.choice(SECRET_NAMES).replace("bearer", "token") + rng.choice((" = ", "=", ": ", " := "))
        elif kind == 0 or kind == 1:
            lead += " " + rng.choice(("commit", "sha1", "checksum", "uuid", "id", "revision", "hash", "etag")) + rng.choice((" ", ": ", "="))
        elif kind == 8:
            lead += " " + rng.choice(SECRET_NAMES) + rng.choice((" = ", ": "))
        else:
            lead, quote = lead + " ", rng.choice(("", "", '"'))
        text = f"{lead}{quote}{value}{quote} {tail}"
        out.append((text, len(lead) + len(quote), len(lead) + len(quote) + len(value), secret))
    return out


def train(spark: SparkSession, findings=None, model: str = MODEL):
    """A fitted forest. findings: (text, start, end, secret) rows, a bounded list; by default the examples."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    describe = Describer(list(dictionary(model)))
    rows = findings if findings is not None else examples(words=dictionary(model))
    data = spark.createDataFrame([(float(y), Vectors.dense(describe(t, a, b))) for t, a, b, y in rows], ["label", "features"])
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(data.repartition(2))


def found(docs: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """id, start_char, n_chars, value and f, the features of each candidate."""
    shared = docs.sparkSession.sparkContext.broadcast(list(dictionary(model)))

    def described(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describe = Describer(shared.value)
        for pdf in source:
            rows = [(i, a, b - a, t[a:b], describe(t, a, b)) for i, t in zip(pdf["id"], pdf["text"], strict=True) if t for a, b in candidates(t)]
            out = pd.DataFrame(rows, columns=["id", "start_char", "n_chars", "value", "f"])
            out["id"] = out["id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(described, "id long, start_char long, n_chars long, value string, f array<double>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings=None, model: str = MODEL) -> DataFrame:
    """id, start_char, n_chars, value_sha256, score, secret for each candidate; the value itself isn't repeated."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    forest = train(docs.sparkSession, findings, model)
    described = found(docs, id_col, text_col, model).withColumn("features", array_to_vector("f"))
    scored = forest.setFeaturesCol("features").transform(described)
    chance = F.element_at(vector_to_array("probability"), 2) if forest.numClasses > 1 else F.lit(0.0)
    return scored.select(F.col("id").alias(id_col), "start_char", "n_chars", F.sha2("value", 256).alias("value_sha256"), F.round(chance, 6).alias("score")).withColumn("secret", F.col("score") >= THRESHOLD)
