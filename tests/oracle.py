"""A plain scalar restatement of the sequence features, shared with no engine code."""

import math


def features(read, counts):
    """read: observed ids; counts: one list of 95 counts for each position. A dict for each position."""
    out = []
    bucket_q = lambda q: sum(q > b for b in (9, 19, 24, 29, 34, 39))
    bucket_r = lambda r: min(10, max(0, r + 5))
    for i, (o, c) in enumerate(zip(read, counts, strict=True)):
        total = max(sum(c), 1e-12)
        p = [x / total for x in c]
        q_hat = c.index(max(c))
        r = o - q_hat
        out.append(
            {
                "q_hat": q_hat,
                "residual": r,
                "target": r + 94,
                "max_prob": p[q_hat],
                "entropy": -sum(x * math.log(max(x, 1e-12)) for x in p) / math.log(95),
                "expected_q": sum(x * q for q, x in enumerate(p)) / 94,
                "rel_pos": i / max(len(read) - 1, 1),
                "len_norm": min(len(read), 10_000) / 10_000,
                "bits": -math.log2(max(p[o], 1e-12)),
                "log_p0_r": [math.log(max(p[q_hat + k] if 0 <= q_hat + k < 95 else 0.0, 1e-12)) for k in range(-94, 95)],
                "q_bucket": bucket_q(o),
                "r_bucket": bucket_r(r),
            }
        )
    for i, row in enumerate(out):
        row["prev_q"] = read[i - 1] if i else 95
        row["prev_r"] = out[i - 1]["target"] if i else 189
        for kind, ks, base, bos in (("q", (2, 3, 4), 8, 7), ("r", (2, 3, 4, 6), 12, 11)):
            row[f"{kind}mer"] = [token([x[f"{kind}_bucket"] for x in out], i, k, 1, base, bos, 4096) for k in ks]
    return out


def token(buckets, i, k, stride, base, bos, vocab):
    code = 0
    for d in range(k, 0, -1):
        j = i - d * stride
        code = (code * base + (buckets[j] if j >= 0 else bos)) % vocab
    return code
