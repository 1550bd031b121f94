"""Secret scans: known shapes, and a sliding window of Shannon entropy over candidate strings.

Native. A candidate is a maximal run of token characters, split at '=' and, where it is a path or holds a
placeholder, at "/"; the class of each part (hex, upper, mixed, letters) sets the window and the threshold. The entropy of each window
follows from that of the one before by the counts of the character that leaves and of the one that enters.
A candidate gives one span, from the first to the end of the last window over the threshold; what lies
between them belongs to it, cold or not. Parts on the allow-list give no entropy span; base spans always stay.

Defined results: a null or empty text has no spans (the digest of the empty string); offsets are
code points, ends exclusive; repeated rows give repeated results; an empty table gives no rows;
columns other than doc_id and text are ignored. Whole texts of any length are scanned: offsets
come from running sums over blocks of matches.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

# The base shapes of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Candidates are at least this long; every access and hex match lies in one.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: class, what a whole candidate looks like, window, bits a character.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 16, 2.6),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 16, 3.1),
    ("mixed", r"^(?=.*[0-9])(?=.*[A-Za-z]).+$", 16, 3.5),
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", 16, 3.5),
)
#: Values that look random and are no secrets, as a whole: ids and digests of pages.
IDS = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(256|384|512)-",
)
#: The same for values that are judged by their parts between slashes then: alphabets, placeholders, paths.
PARTED = (
    r"(?i)example|placeholder|x{6,}|abcdefghij|0123456789",
    r"^[A-Za-z0-9_=-]*+(?:/[a-z]{2,}[A-Za-z0-9_=-]*+(?=/|$))++(?:/[A-Za-z0-9_+-]*+)*+$",
)
#: Names made of words, such as CamelCase. Groups repeat possessively: a greedy one takes a frame of the stack at
#: each turn, which a long run doesn't leave.
NAME = r"^[A-Z]{0,4}[a-z]{2,}(?:[A-Z]{1,4}[a-z]{2,})*+[A-Z]{0,4}$"
BLOCK = 256
#: Characters of a value that are taken apart at a time.
STRETCH = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column) -> Column:
    """Sums of what lies before each element, by blocks: n * BLOCK steps, not n^2."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    n = F.size(lengths)
    last = F.floor((n - 1) / BLOCK).cast("int")
    in_blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    before = let(in_blocks, lambda s: F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(s, F.lit(1), b))))
    sums = let(before, lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(s, F.floor(i / BLOCK).cast("int")) + total(
        F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))
    return F.when(n > 0, sums).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, end, value): the leftmost non-overlapping matches, in code points."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("v"))
    gaps = F.split(text, pattern, -1)

    def placed(m: Column, g: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x["m"]))
        return let(prefix_sums_of(steps), lambda s: F.transform(m, lambda x, i: let(
            F.get(s, i) + F.length(F.get(g, i)), lambda start: F.struct(
                start.alias("start"), (start + F.length(x["m"])).alias("end"), x["v"].alias("value")))))

    return let(found, lambda m: let(gaps, lambda g: placed(m, g)))


def prefix_sums_of(steps: Column) -> Column:
    return let(steps, prefix_sums)


EMPTY = "array<struct<start:int,end:int,value:string>>"


def where(hint: Column, spans: Column) -> Column:
    return F.when(hint, spans).otherwise(F.array().cast(EMPTY))


def hot_window(value: Column, window: int, bits: float) -> Column:
    """(first, last, window): starts of the first and last windows with so many bits; -1 if none.

    With S the sum of n*log2(n) over the window's counts n, its entropy is log2(window) - S/window. A step
    changes the counts of two characters, that which enters and that which leaves, by one, and S by what follows from
    their counts in the window before. Values are walked through in stretches, each with the window before it.
    """
    g = F.array(*[F.lit(0.0 if n == 0 else n * log2(n)) for n in range(window + 2)])
    most = (log2(window) - bits) * window + 1e-9

    def step(s: Column, k: Column, codes: Column) -> Column:
        # codes: a full window before the stretch (0 where there is none), then the stretch; k counts from 1 in it
        def entered(held: Column) -> Column:
            enters, leaves = F.get(codes, window + k - 1), F.get(codes, k - 1)
            count = lambda c: F.lit(window) - F.size(F.array_remove(held, c))
            more = let(count(enters), lambda n: F.get(g, n + 1) - F.get(g, n))
            less = F.when(leaves > 0, let(count(leaves), lambda n: F.get(g, n - 1) - F.get(g, n))).otherwise(F.lit(0.0))
            change = F.when(enters == leaves, F.lit(0.0)).otherwise(more + less)
            return let(s["s"] + change, lambda t: let((leaves >= 0) & (s["at"] + k >= window) & (t <= F.lit(most)), lambda hot: F.struct(
                t.alias("s"), s["at"].alias("at"),
                F.when(hot & (s["first"] < 0), s["at"] + k - window).otherwise(s["first"]).alias("first"),
                F.when(hot, s["at"] + k - window).otherwise(s["last"]).alias("last"), s["tail"].alias("tail"))))

        return let(F.slice(codes, k, F.lit(window)), entered)

    def stretch(s: Column, part: Column) -> Column:
        chars = F.filter(F.split(part, ""), lambda c: c != "")
        return let(F.concat(s["tail"], F.transform(chars, F.ascii)), lambda codes: let(F.aggregate(
            F.sequence(F.lit(1), F.size(codes) - window), s, lambda a, k: step(a, k, codes)), lambda done: F.struct(
                done["s"].alias("s"), (s["at"] + F.size(codes) - window).alias("at"), done["first"].alias("first"), done["last"].alias("last"),
                F.slice(codes, F.size(codes) - window + 1, F.lit(window)).alias("tail"))))

    begin = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.array_repeat(F.lit(0), window).alias("tail"))
    return F.aggregate(F.regexp_extract_all(value, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), begin, stretch, lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), F.lit(window).alias("window")))


def matches_any(v: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | v.rlike(pattern)
    return found


def parts_of(x: Column, mark: str) -> Column:
    """The parts of at least 16 characters of x (start, end, value) between marks, in place."""
    def placed(parts: Column) -> Column:
        steps = F.transform(parts, lambda p: F.length(p) + 1)
        return let(prefix_sums_of(steps), lambda s: F.transform(parts, lambda p, i: F.struct(
            (x["start"] + F.get(s, i)).alias("start"), (x["start"] + F.get(s, i) + F.length(p)).alias("end"), p.alias("value"))))

    return F.filter(let(F.split(x["value"], mark, -1), placed), lambda p: F.length(p["value"]) >= 16)


def values_of(candidates: Column) -> Column:
    """What is judged of each run: its values between '='; of a path or a value with a placeholder its
    parts between '/'. Ids aren't judged."""
    def values(x: Column) -> Column:
        own = F.filter(parts_of(x, "="), lambda v: ~matches_any(v["value"], IDS))
        return F.flatten(F.transform(own, lambda v: F.when(
            v["value"].contains("/") & matches_any(v["value"], PARTED), parts_of(v, "/")).otherwise(F.array(v))))

    return F.flatten(F.transform(candidates, values))


def entropy_spans(candidates: Column) -> Column:
    """From the first to the end of the last hot window of each value that isn't allowed."""
    def judged(x: Column) -> Column:
        v = x["value"]
        chain = None
        none = F.lit(None).cast("struct<first:int,last:int,window:int>")
        for _, shape, window, bits in CLASSES:
            hot = hot_window(v, window, bits)
            test = v.rlike(shape) & (F.length(v) >= window)
            chain = F.when(test, hot) if chain is None else chain.when(test, hot)
        allowed = matches_any(v, (*IDS, PARTED[0], NAME))
        return let(F.when(allowed, none).otherwise(chain.otherwise(none)), lambda h: F.struct(
            (x["start"] + h["first"]).alias("start"), (x["start"] + h["last"] + h["window"]).alias("end"),
            F.when(h["first"] >= 0, v).alias("value")))

    return F.filter(F.transform(values_of(candidates), judged), lambda x: x["value"].isNotNull())


KINDS = ("assign", "access", "hex", "entropy")


def joined(kinds: dict[str, Column]) -> Column:
    def tag(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = [tag(k, spans) for k, spans in kinds.items()]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, and per kind an array of (start, end, value); one row a document, no shuffle."""
    text = text_or_empty()
    long_run = text.rlike(CANDIDATE)
    assign = F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    found = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        where(text.rlike(ASSIGN_HINT), assign).alias("assign"),
        where(long_run & text.contains("AKIA"), located(text, ACCESS)).alias("access"),
        where(long_run & text.rlike(HEX), located(text, HEX)).alias("hex"),
        # only runs with a digit, or with letters of both cases, can belong to a class
        where(long_run, entropy_spans(F.filter(located(text, CANDIDATE), lambda x: x["value"].rlike("[0-9]|^(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])")))).alias("entropy"),
    )
    return found


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = {k: F.col(k) for k in KINDS[:3]}
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(base | {"entropy": F.col("entropy")}).alias("spans"))
