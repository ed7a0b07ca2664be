"""Quality, fingerprints and toxicity against versions in plain Python that share no code with the operators but their constants."""

import hashlib
import math
import re

import pytest
import regex

from quire.llm import fingerprint, hashing, quality, toxicity
from quire.llm._common import table

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mixed(h):
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ h >> shift) * factor & MASK
    return h ^ h >> 33


def hashed(data, fold=True):
    """Polynomial of the bytes' table values, first byte first."""
    total, power = 0, 1
    for b in data:
        b += 32 * (fold and 65 <= b <= 90)
        total = total + mixed((b + 1) * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D & MASK) * power & MASK
        power = power * hashing._BASE & MASK
    return mixed(total)


def shingle(words):
    h = hashed(words[0])
    for w in words[1:]:
        h = h * int(hashing._STEP) + hashed(w) & MASK
    return mixed(h + len(words) * 0xA0761D6478BD642F & MASK)


def mark(text, k=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    own = {shingle(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    kept = sorted(h >> 30 for h in own if h < 1 << 62)
    return len(own), sum(mixed(h ^ 0xC0FFEE) for h in own) & MASK, kept


def shown(m):
    return f"{m[0]}:{m[1]:016x}:{''.join(f'{v:08x}' for v in m[2])}"


def alike(x, y):
    if x[:2] == y[:2]:
        return 1.0
    a, b = set(x[2]), set(y[2])
    return len(a & b) / len(a | b) if a | b else 0.0


def test_fingerprints_by_hand(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.op6_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        own, changed, following = mark(t), mark(e), mark(n)
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), shown(own), shown(changed))
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((alike(own, changed), alike(own, following)), abs=1e-12)


def test_toxicity_by_hand(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    weights = dict(zip(model.places.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, SF).collect()}
    assert weights and len(weights) < 20_000
    for i, t in docs.collect():
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())
        h = [hashed(w) for w in words]
        places = {v * 0x2545F4914F6CDD1D & MASK for v in h}
        places |= {hashed(w[:n]) * (0xDA942042E4DD58B5 + 2 * n) & MASK for n in toxicity.STEMS for w in words if len(w) > n}
        places |= {mixed(a * salt + b & MASK) for gap, salt in ((1, 0x9E6C63D0876A9A47), (2, 0xC2B2AE3D27D4EB4F)) for a, b in zip(h, h[gap:])}
        z = model.bias + sum(weights.get(p, 0.0) for p in {v >> 64 - toxicity.BITS for v in places})
        score = 1 / (1 + math.exp(-max(-35, min(35, z))))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == (score >= toxicity.THRESHOLD)


def test_quality_by_hand(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rules = quality.train(docs, table(spark, SF, "labels"))
    got = {r.doc_id: r for r in quality.op3_quality(spark, SF).collect()}
    assert rules.rules
    for i, t in docs.collect():
        t = t or ""
        words, lines, parts = re.findall(r"[^ \t-\r]+", t), t.split("\n"), re.split(r"[ \n]", t)
        n, w = max(1, len(t)), max(1, len(words))
        f = {
            "chars": len(t), "words": len(words), "word_length": len(t) / w, "upper": len(regex.findall(r"\p{Lu}", t)) / n, "digits": len(re.findall("[0-9]", t)) / n, "symbols": len(re.findall(r"[#$%&*|!?~^<>{}=+@_\[\]\\/]", t)) / w,
            "stops": len(re.findall("[.,;:]", t)) / w, "doubled": sum(a == b != "" for a, b in zip(parts, parts[1:])) / w, "distinct": len(set(re.split(r"[ \t-\r]+", t.lower()))) / w, "line_words": len(words) / len(lines), "distinct_lines": len(set(lines)) / len(lines),
        }
        z = rules.intercept + sum(c for rule, c in rules.rules if all(f[name] > cut if above else f[name] <= cut for name, above, cut in rule))
        score = 1 / (1 + math.exp(-z))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == (score >= quality.THRESHOLD)
