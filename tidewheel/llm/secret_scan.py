"""Secrets in texts: fixed patterns, and a battery of randomness tests under false-discovery control.

Only DataFrame functions. Patterns (assign, access, hex) give the base spans. Further candidates are runs of
LEAST or more characters of base-64 alphabets. Each has an inferred encoding (decimal, hex, base 32, base 36,
base 64). If it is random over that alphabet, three statistics are about standard normal: chi-squared uniformity,
runs above and below the middle of the alphabet, lag-1 serial correlation; a candidate that fails one of these
tests is no secret. Against the opposite null, text that people write, it gets a p-value: symbols of such text
repeat with probability NATURAL_REPEAT and change between lower case, upper case and digits with probability
NATURAL_CHANGE, so both counts have known means and deviations at each length, and the two p-values combine by
Fisher's method. Candidates of all documents are then held against each other within classes of length
(Benjamini and Hochberg at RATE, on a histogram of p-values: a few counters, whatever the input's size); those
that pass and touch no base span are spans of the kind random;
a candidate that touches one is also tried in the pieces that base spans leave of it.

Positions count code points, ends are exclusive. Null and empty texts have no spans. A text is scanned whole;
its work grows with its length and its number of matches. Rows stand alone but for the counters, so nulls and
repeats of ids do no harm. An empty table gives an empty one; columns that aren't kept may have any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._shared import written

#: Pattern and least length of each base kind; for assign, of the value (group 1). The longest run of a class of
#: characters is one match, so there the least length is part of the pattern.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
}
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding: pattern and alphabet, the first that fits.
ENCODINGS = {
    "decimal": ("^[0-9]+$", DIGITS),
    "hex": ("^[0-9a-f]+$", DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "base36": ("^[0-9a-z]+$", DIGITS + LOWER),
    "BASE36": ("^[0-9A-Z]+$", DIGITS + UPPER),
    "base64": ("", UPPER + LOWER + DIGITS + "+/-_"),
}
NATURAL_REPEAT, NATURAL_CHANGE = 0.075, 0.15
#: |z| beyond which a test rejects randomness; false discoveries allowed; upper ends of the classes of length; histogram bins of a factor of ten, and in all.
REJECT, RATE, LENGTHS, FINE, BINS = 3.3, 0.01, (24, 32, 48, 96), 8, 320
#: Matches summed at once.
BLOCK = 256
SPAN = "array<struct<start:int,end:int,kind:string>>"


def before(sizes: str) -> Column:
    """The sum of all earlier elements for each element of an integer array column, in blocks."""
    return F.expr(f"""
      transform({sizes}, (x, i) -> aggregate(slice({sizes}_sums, 1, i div {BLOCK}), 0L, (a, y) -> a + y)
        + aggregate(slice({sizes}, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, (a, y) -> a + y))""")


def block_sums(sizes: str) -> Column:
    return F.expr(f"transform(sequence(0, greatest(0, size({sizes}) - 1) div {BLOCK}), b -> aggregate(slice({sizes}, b * {BLOCK} + 1, {BLOCK}), 0L, (a, y) -> a + y))")


def located(df: DataFrame, text: str, name: str, pattern: str, group: int | None = None) -> DataFrame:
    """`df` with name: an array of (start, end, part) for every match; part is the match, or its group."""
    hit = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_all", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(f"{name}_all") > 0
    df = df.withColumn(f"{name}_gap", F.when(some, F.split(text, pattern)).otherwise(none))
    df = df.withColumn(f"{name}_part", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col(f"{name}_all"))
    df = df.withColumn(f"{name}_step", F.expr(f"transform({name}_all, (m, i) -> cast(length(m) + length({name}_gap[i]) as bigint))"))
    df = df.withColumn(f"{name}_step_sums", block_sums(f"{name}_step"))
    df = df.withColumn(f"{name}_at", before(f"{name}_step"))
    made = F.expr(f"transform({name}_all, (m, i) -> struct(cast({name}_at[i] + length({name}_gap[i]) as int) as start, cast({name}_at[i] + length({name}_gap[i]) + length(m) as int) as end, {name}_part[i] as part))")
    return df.withColumn(name, made).drop(*[f"{name}_{x}" for x in ("all", "gap", "part", "step", "step_sums", "at")])


def normal_tail(z: Column) -> Column:
    """The upper tail of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""
    size = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * size)
    body = 0.3989422804014327 * F.exp(-size * size / 2) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, body).otherwise(1 - body)


def total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, y: a + value(y))


def neighbours(first: int, last: Column, value) -> Column:
    """The sum of value(i) for i from first to last."""
    return total(F.sequence(F.lit(first), last), value)


def alphabet_of(token: Column) -> Column:
    out = F.lit(ENCODINGS["base64"][1])
    for pattern, alphabet in reversed(list(ENCODINGS.values())[:-1]):
        out = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


def folded(token: Column) -> Column:
    """Each character's class: lower case, upper case, digit, sign."""
    return F.translate(token, LOWER + UPPER + DIGITS + "+/-_", "a" * 26 + "b" * 26 + "c" * 10 + "dddd")


def one_if(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


#: The battery, field by field; each is a function of the candidate's struct with the fields before it.
STEPS = [
    ("alphabet", lambda x: alphabet_of(x["part"])),
    ("n", lambda x: F.length(x["part"]).cast("double")),
    ("k", lambda x: F.length(x["alphabet"]).cast("double")),
    ("marks", lambda x: F.transform(F.sequence(F.lit(1), F.length(x["part"])), lambda i: F.instr(x["alphabet"], F.substring(x["part"], i, F.lit(1))).cast("double"))),
    ("squares", lambda x: neighbours(1, F.length(x["alphabet"]), lambda i: F.pow(F.length(x["part"]) - F.length(F.replace(x["part"], F.substring(x["alphabet"], i, F.lit(1)), F.lit(""))), F.lit(2.0)))),
    ("chi", lambda x: (x["k"] * x["squares"] / x["n"] - x["n"] - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1) * (x["n"] - 1) / x["n"])),
    ("high", lambda x: total(x["marks"], lambda y: one_if(y > x["k"] / 2))),
    ("runs", lambda x: 1 + neighbours(1, F.size(x["marks"]) - 1, lambda i: one_if((F.get(x["marks"], i) > x["k"] / 2) != (F.get(x["marks"], i - 1) > x["k"] / 2)))),
    ("runs_mean", lambda x: 2 * x["high"] * (x["n"] - x["high"]) / x["n"] + 1),
    ("runs_z", lambda x: F.coalesce(F.try_divide(x["runs"] - x["runs_mean"], F.sqrt(F.greatest(F.lit(0.0), (x["runs_mean"] - 1) * (x["runs_mean"] - 2) / (x["n"] - 1)))), F.lit(99.0))),
    ("mean", lambda x: total(x["marks"], lambda y: y) / x["n"]),
    ("spread", lambda x: total(x["marks"], lambda y: (y - x["mean"]) * (y - x["mean"]))),
    ("serial", lambda x: neighbours(1, F.size(x["marks"]) - 1, lambda i: (F.get(x["marks"], i) - x["mean"]) * (F.get(x["marks"], i - 1) - x["mean"]))),
    ("serial_z", lambda x: F.coalesce((F.try_divide(x["serial"], x["spread"]) + 1 / x["n"]) * F.sqrt(x["n"]), F.lit(99.0))),
    ("random", lambda x: (x["chi"] < REJECT) & (F.abs(x["runs_z"]) < REJECT) & (F.abs(x["serial_z"]) < REJECT)),
    ("pairs", lambda x: x["n"] * (x["n"] - 1) / 2),
    ("repeats_z", lambda x: (NATURAL_REPEAT * x["pairs"] - (x["squares"] - x["n"]) / 2 - 0.5) / F.sqrt(NATURAL_REPEAT * (1 - NATURAL_REPEAT) * x["pairs"])),
    ("classes", lambda x: folded(x["part"])),
    ("changes", lambda x: neighbours(2, F.length(x["part"]), lambda i: one_if(F.substring(x["classes"], i, F.lit(1)) != F.substring(x["classes"], i - 1, F.lit(1))))),
    ("changes_z", lambda x: (x["changes"] - 0.5 - NATURAL_CHANGE * (x["n"] - 1)) / F.sqrt(NATURAL_CHANGE * (1 - NATURAL_CHANGE) * (x["n"] - 1))),
    ("joint", lambda x: -F.log(F.greatest(F.lit(1e-300), normal_tail(x["repeats_z"]))) - F.log(F.greatest(F.lit(1e-300), normal_tail(x["changes_z"])))),
    ("tens", lambda x: (x["joint"] - F.log(1 + x["joint"])) / 2.302585092994046),
    ("bin", lambda x: F.when(x["random"], F.least(F.lit(BINS), F.floor(x["tens"] * FINE)).cast("int")).otherwise(0)),
    ("class", lambda x: sum((F.when(x["n"] >= most, 1).otherwise(0) for most in LENGTHS), F.lit(0))),
]


def with_field(name: str, value):
    return lambda x: x.withField(name, value(x))


def pieces(cands: str) -> Column:
    """What remains of candidates that overlap base spans, in pieces of LEAST or more characters."""
    near = "filter(base__, b -> b.start < x.end and x.start < b.end)"
    free = f"filter(array_distinct(concat(array(x.start), transform({near}, b -> b.end))), s -> s < x.end and not exists(base__, b -> b.start <= s and s < b.end))"
    cut = f"transform({free}, s -> struct(x, s, least(x.end, coalesce(array_min(transform(filter(base__, b -> b.start > s), b -> b.start)), x.end)) as e))"
    touched = f"filter({cands}, x -> exists(base__, b -> b.start < x.end and x.start < b.end))"
    return F.expr(f"transform(filter(flatten(transform({touched}, x -> {cut})), p -> p.e - p.s >= {LEAST}), p -> struct(p.s as start, p.e as end, substring(p.x.part, p.s - p.x.start + 1, p.e - p.s) as part))")


def candidates(df: DataFrame, text: str) -> DataFrame:
    """`df` with cands: an array of (start, end, class, bin) for every candidate, and for every piece of one that its base spans (base__) leave."""
    df = located(df, text, "cands", CANDIDATE)
    df = df.withColumn("cands", F.concat("cands", pieces("cands")))
    for name, value in STEPS:
        df = df.withColumn("cands", F.transform("cands", with_field(name, value)))
    return df.withColumn("cands", F.transform("cands", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["class"].alias("class"), x["bin"].alias("bin"))))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, base and spans: arrays of (start, end, kind), sorted by start and then by kind in the order assign,
    access, hex, random. Kept columns named base or spans give way to these."""
    kept = F.struct(*[f"`{c}`" for c in keep if c.lower() not in ("base", "spans")])
    df = docs.select(kept.alias("kept__"), F.coalesce(F.col(text), F.lit("")).alias("text__"))
    for kind, (pattern, least) in BASE.items():
        df = located(df, "text__", kind, pattern, 1 if kind == "assign" else None)
        if kind == "assign":
            df = df.withColumn(kind, F.expr(f"filter({kind}, x -> length(x.part) >= {least})"))
    order = "concat(" + ", ".join(f"transform({kind}, x -> struct(x.start as start, {i} as rank, x.end as end, '{kind}' as kind))" for i, kind in enumerate(BASE)) + ")"
    df = candidates(df.withColumn("base__", F.expr(f"array_sort({order})")).drop(*BASE), "text__").drop("text__")
    df = df.withColumn("cands", F.expr("transform(cands, x -> struct(x.start as start, x.end as end, x.class as class, x.bin as bin, exists(base__, b -> b.start < x.end and x.start < b.end) as base))"))
    df = written(df)
    passed = " or ".join(f"(x.class = {c} and x.bin >= {b})" for c, b in least_bins(df).items()) or "false"
    added = F.expr(f"transform(filter(cands, x -> not x.base and ({passed})), x -> struct(x.start as start, {len(BASE)} as rank, x.end as end, 'random' as kind))")
    plain = "transform({}, x -> struct(x.start as start, x.end as end, x.kind as kind))"
    df = df.withColumn("spans__", F.array_sort(F.concat("base__", added)))
    return df.select("kept__.*", F.expr(plain.format("base__")).alias("base"), F.expr(plain.format("spans__")).alias("spans"))


def least_bins(df: DataFrame) -> dict[int, int]:
    """For each class of length, the least histogram bin that the procedure accepts; at most one counter a class and bin comes to the driver."""
    counts = df.select(F.explode("cands").alias("x")).groupBy("x.class", "x.bin").agg(F.count("*").alias("n")).collect()
    out = {}
    for c in {r["class"] for r in counts}:
        of = {r["bin"]: r["n"] for r in counts if r["class"] == c}
        total, seen = sum(of.values()), 0
        for b in sorted(of, reverse=True):
            seen += of[b]
            if b > 0 and 10.0 ** (-b / FINE) <= RATE * seen / total:
                out[c] = b
    return out


def written_spans(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[secret]") -> DataFrame:
    """`df` with every span of its text replaced by `mark`; overlapping spans become one mark."""
    df = df.withColumn("reach__", F.expr(f"transform({spans}, (x, i) -> coalesce(array_max(transform(slice({spans}, 1, i), y -> y.end)), 0))"))
    parts = F.expr(f"transform({spans}, (x, i) -> if(x.start >= reach__[i] and (i = 0 or x.start > 0), concat(substring(`{text}`, reach__[i] + 1, x.start - reach__[i]), '{mark}'), ''))")
    tail = F.expr(f"substring(`{text}`, coalesce(array_max(transform({spans}, y -> y.end)), 0) + 1)")
    return df.withColumn(text, F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(text))).drop("reach__")
