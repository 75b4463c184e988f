"""Precision and recall of the Markov scan on documents with planted strings that no training sample holds."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from palimpsest.llm import secrets as S

from .conftest import prose

ALPHABETS = {"hex": "0123456789ABCDEF", "all": string.ascii_letters + string.digits, "lower": string.ascii_lowercase, "mixed": string.ascii_lowercase + string.digits}
PLAIN = ["the_quick_brown_fox_jumps", "Rechtsschutzversicherungsgesellschaften", "https/www/example/org/articles/2019", "README-installation-guide", "getUserAccountDetails", "incomprehensibilities", "2024-01-31-release-notes", "=" * 40, "1234567890123456"]


def brute(token: str, table: list[float]) -> tuple[float, int, int]:
    """The best stretch by trying all."""
    at = [S._CLASSES.index(c) for c in token]
    x = [table[a * S._N + b] for a, b in zip(at, at[1:], strict=False)]
    return max(((sum(x[i:j]), i, j + 1) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0.0, 0, 0))


def test_best_stretch(spark):
    table, rng = S.trained(), random.Random(5)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(12, 30))) for a in ALPHABETS.values() for _ in range(5)] + PLAIN[:3]
    rows = spark.createDataFrame(list(enumerate(tokens)), "i int, t string").select("i", S._stretch(F.col("t"), F.array(*map(F.lit, table))).alias("s")).collect()
    for r in rows:
        best, lo, hi = brute(tokens[r.i], table)
        assert abs(r.s.best - max(best, 0)) < 1e-9 and (best <= 0 or (r.s.lo, r.s.hi) == (lo, hi))


def test_measured_on_documents(spark):
    rng = random.Random(77)
    planted = {}
    for i in range(120):
        kind = list(ALPHABETS)[i % 4]
        token = "".join(rng.choice(ALPHABETS[kind]) for _ in range(24))
        before = ["", "LONG_SETTING_NAME=", "/usr/share/lib/"][i % 3]
        planted[i] = (kind, len(prose(i, 40)) + 1 + len(before), token, f"{prose(i, 40)} {before}{token} {prose(i + 1, 40)}")
    clean = [f"{prose(i, 80)} {PLAIN[i % len(PLAIN)]} {prose(i + 500, 80)}" for i in range(120)]
    docs = spark.createDataFrame([(i, p[3]) for i, p in planted.items()] + [(1000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in S.scan(docs).collect()}
    caught = [i for i, (_, at, token, _) in planted.items() if any(s < at + len(token) and at < e for s, e in got[i])]
    wrong = [i for i in got if i >= 1000 and got[i]]
    assert len(caught) >= 0.95 * len(planted) and len(wrong) <= 0.02 * len(clean)
    covered = [max(min(e, planted[i][1] + 24) - max(s, planted[i][1]) for s, e in got[i]) for i in caught]
    assert sum(covered) >= 0.9 * 24 * len(caught)  # names in capitals beside a secret may be taken along
