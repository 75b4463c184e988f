"""Secret scans: base patterns and character Markov models, by Spark SQL functions alone.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained on the
driver from labelled samples. In each token of 12 or more characters of the base64, hex and identifier alphabets the stretch
with the highest log-likelihood ratio of its transitions is found; it is a secret if that ratio is above a threshold, a higher
one for stretches of a single case without digits.
Base spans stay whatever the models say. Offsets are code points, ends exclusive.

Defined cases: a null text counts as empty; a text without spans gives empty span lists and the digest of the empty string;
spans of different kinds may overlap; the spans of `redacted` that overlap or touch are united; rows and other columns pass.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import common as C

BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
)
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
#: Log-likelihood ratio above which a stretch is a secret, and its least length: of stretches with digits or both cases, and of plain
#: ones, which are words much more often, so that more must speak for a secret.
MIXED, SHORTEST, PLAIN, SHORTEST_PLAIN = 10.0, 12, 18.0, 16
_CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_N = len(_CLASSES)

#: Ordinary identifiers are made of such parts, as code, file names, slugs and prose join them.
_PARTS = """get set add remove update delete create find load save read write parse format print user name list item index count total value
config option default handler manager service client server request response session connection database table column row key type
string number integer boolean array object map filter reduce sort merge split join file path directory image video audio document page
header footer content title message error warning exception event listener callback function method class interface module package
version release build test check validate verify process thread queue stack tree node graph edge vertex matrix vector model view
controller template render layout style color width height size length position offset start end begin finish first last next previous
current global local static public private internal external input output stream buffer cache memory storage network socket port host
address email phone account profile order product price customer invoice payment report summary detail history status state city country
region language locale time date day month year hour minute second millisecond timestamp duration interval schedule calendar
information international administration representative characterization implementation configuration authentication transformation
verantwortung entwicklung gesellschaft wissenschaft geschwindigkeit veranstaltung développement gouvernement responsabilité environnement
información administración características desarrollo establecimiento conocimiento experience management government university
thing other there would their about which because between through another without against however together different important
http https www com org net html index php blog post article category tag search archive download upload image thumb media assets""".split()


def ordinary(n: int, rng: random.Random) -> list[str]:
    """Labelled samples of identifiers: parts joined as snake, kebab, camel, path or plain, some with small numbers."""
    out = []
    for _ in range(n):
        parts = [re.sub(r"[^a-z]", "", rng.choice(_PARTS)) or "x" for _ in range(rng.randint(2, 6))]
        style = rng.randrange(7)
        if style == 0:
            parts = [parts[0], *(p.capitalize() for p in parts[1:])]
        elif style == 1:
            parts = [p.capitalize() for p in parts]
        elif style == 2:
            parts = [p.upper() for p in parts]
        if rng.random() < 0.4:
            parts.insert(rng.randint(1, len(parts)), rng.choice([str(rng.randint(0, 99)), str(rng.randint(1990, 2030)), f"v{rng.randint(1, 9)}"]))
        out.append(rng.choice(["_", "-", "/", "_", "-", "", ""] if style > 1 else [""]).join(parts))
    out += ["".join(rng.choice("0123456789") for _ in range(rng.randint(8, 24))) for _ in range(n // 10)]
    out += [rng.choice("=-_/+") * rng.randint(8, 40) for _ in range(n // 20)]
    return out


def random_strings(n: int, rng: random.Random) -> list[str]:
    """Labelled samples of secrets: uniform strings over the alphabets that keys are written in."""
    kinds = ["0123456789abcdef", _CLASSES[:62], _CLASSES[:64], _CLASSES[:62] + "_-", _CLASSES[26:62], _CLASSES[:26] + "0123456789"]
    return ["".join(rng.choice(kinds[i % len(kinds)]) for _ in range(rng.randint(16, 64))) for i in range(n)]


def ratios(secret: list[str], plain: list[str], smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, row-major by first character; positive speaks for a secret."""

    def logs(samples: list[str]) -> list[list[float]]:
        counts = [[smooth] * _N for _ in range(_N)]
        for s in samples:
            at = [_CLASSES.index(c) for c in s if c in _CLASSES]
            for a, b in zip(at, at[1:], strict=False):
                counts[a][b] += 1
        return [[math.log(x / sum(row)) for x in row] for row in counts]

    p, q = logs(secret), logs(plain)
    return [round(p[a][b] - q[a][b], 4) for a in range(_N) for b in range(_N)]


def trained(n: int = 6000, seed: int = 20) -> list[float]:
    rng = random.Random(seed)
    return ratios(random_strings(n, rng), ordinary(n, rng))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches: the gaps between them give their places."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    whole = T.spans(text, pattern)
    if not group:
        return F.transform(whole, lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["len"]).alias("end"), p["value"].alias("value")))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.zip_with(whole, values, lambda p, v: F.struct(p["start"].alias("start"), (p["start"] + p["len"]).alias("end"), v.alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), both).otherwise(none)


def _stretch(token: Column, table: Column) -> Column:
    """struct<best, lo, hi>: the stretch of a token with the highest log-likelihood ratio, so that a name or path that a secret is
    joined to does not hide it. One pass over the characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(_CLASSES), c) - 1)
    start = F.struct(F.lit(-1).alias("prev"), F.lit(0).alias("i"), F.lit(0.0).alias("cur"), F.lit(0).alias("at"), F.lit(0.0).alias("best"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))

    def step(acc: Column, c: Column) -> Column:
        ratio = F.when(acc["prev"] < 0, 0.0).otherwise(F.element_at(table, acc["prev"] * _N + c + 1))
        return F.struct(c.alias("prev"), (acc["i"] + 1).alias("i"), (F.greatest(acc["cur"], F.lit(0.0)) + ratio).alias("cur"), F.when(acc["cur"] > 0, acc["at"]).otherwise(F.greatest(acc["i"] - 1, F.lit(0))).alias("at"), acc["best"].alias("best"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))

    def kept(acc: Column) -> Column:
        more = acc["cur"] > acc["best"]
        return F.struct(acc["prev"], acc["i"], acc["cur"], acc["at"], F.greatest(acc["cur"], acc["best"]).alias("best"), F.when(more, acc["at"]).otherwise(acc["lo"]).alias("lo"), F.when(more, acc["i"]).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(codes, start, lambda acc, c: T.bound(step(acc, c), kept), lambda acc: F.struct(acc["best"].alias("best"), acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _random(text: Column, ratio: Column) -> Column:
    """array<struct<start, end>>: the stretches of tokens that the models take for random strings."""
    scored = F.transform(found(text, TOKEN), lambda h: F.struct(h["start"].alias("start"), h["value"].alias("value"), _stretch(h["value"], ratio).alias("s")))
    cut = F.transform(scored, lambda h: F.struct((h["start"] + h["s"]["lo"]).alias("start"), (h["start"] + h["s"]["hi"]).alias("end"), h["s"]["best"].alias("best"), F.substring(h["value"], h["s"]["lo"] + 1, h["s"]["hi"] - h["s"]["lo"]).alias("v")))
    mixed = lambda h: F.regexp_like(h["v"], F.lit("[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"))
    return F.filter(cut, lambda h: F.when(mixed(h), (F.length(h["v"]) >= SHORTEST) & (h["best"] > MIXED)).otherwise((F.length(h["v"]) >= SHORTEST_PLAIN) & (h["best"] > PLAIN)))


def spans(text: Column, table: list[float] | None = None) -> Column:
    """array<struct<start, rank, end, kind>> of base spans, then of the models' stretches (kind `random`), sorted by start and kind."""
    text = F.coalesce(text, F.lit(""))
    ratio = F.array(*map(F.lit, table or trained()))

    def named(hits: Column, rank: int, kind: str) -> Column:
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind")))

    def long_enough(hits: Column, least: int) -> Column:
        return F.filter(hits, lambda h: F.length(h["value"]) >= least)

    parts = [named(long_enough(found(text, pattern, int(kind == "assign")), least), rank, kind) for rank, (kind, pattern, least) in enumerate(BASE)]
    return F.array_sort(F.concat(*parts, named(_random(text, ratio), len(BASE), "random")))


def joined(found_: Column) -> Column:
    return F.array_join(F.transform(found_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of spans; a column of that name is replaced."""
    return docs.withColumn(out, spans(F.col(text_col)))


def redacted(text: Column, found_: Column, mark: str = "[SECRET]") -> Column:
    """The text with each united span replaced."""
    united = F.aggregate(
        found_,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    pieces = F.transform(united, lambda s, i: F.concat(F.substring(text, F.when(i == 0, 1).otherwise(F.get(united, i - 1)["end"] + 1), s["start"] - F.when(i == 0, 0).otherwise(F.get(united, i - 1)["end"])), F.lit(mark)))
    return F.when(F.size(found_) > 0, F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(united, -1)["end"] + 1, F.length(text)))).otherwise(text)


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return docs.select("doc_id", *(n(kind) for kind, _, _ in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced and its length counted anew."""
    text, n = C.at(docs, "text"), C.at(docs, "n_chars")
    rows, names = C.apart(docs)
    clean = rows.withColumn("spans", spans(F.col(text))).withColumn(text, redacted(F.col(text), F.col("spans")))
    clean = clean.withColumn(n, F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return C.together(clean, names)
