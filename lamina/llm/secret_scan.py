"""Secret scan: fixed patterns, and sliding-window entropy of long strings, as Spark expressions.

Candidate strings are the runs of each character class. A candidate is scored
by the Shannon entropy of a sliding window, whose character counts and entropy
sum are kept and updated by the character that leaves and the one that enters.
All steps take time in proportion to the text, and no pattern repeats a group
that may backtrack, so long unbroken runs are safe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import without

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Characters of a class, and the bits per character that the fullest window of a run must reach.
CLASSES = {"hex": ("0-9a-fA-F", 3.1), "alnum": ("A-Za-z0-9", 3.9), "base64": ("A-Za-z0-9+/", 3.9), "url": ("A-Za-z0-9_-", 3.9)}
#: The characters of all classes.
ALPHABET = "A-Za-z0-9+/_-"
#: Candidates that look random but aren't secrets: UUIDs, paths and hyphened names, words in one case or camel case,
#: numbers, and those that begin or end with a whole placeholder word.
WORDS = "example|placeholder|dummy|changeme|your|x{4,}|abcdefgh|0123456789|12345678"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z_]*+[/-][A-Za-z_/-]*+$",
    r"^[a-z]++$",
    r"^[A-Z]++$",
    r"^[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+$",
    r"^[0-9+/_-]++$",
    rf"(?i)^(?:{WORDS})(?:[^A-Za-z]|$)",
    rf"(?i)(?:^|[^A-Za-z])(?:{WORDS})$",
)
#: Items of an array that are run through at once, and code points of a block of text.
BLOCK, STRETCH = 256, 4096
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def running(items: Column, start: Column, step, kind: str, block: int = BLOCK) -> Column:
    """The states (of SQL type ``kind``) after each item, ``step(state, item)`` making the next one.

    Arrays grow by copying, so items are run through in blocks, which keeps the work near linear.
    """
    first = F.struct(start.cast(kind).alias("at"), _none(kind).alias("out"))
    blocks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda b: F.slice(items, b * block + 1, block)))

    def within(state, item):
        return let(step(state["at"], item).cast(kind), lambda t: F.struct(t.alias("at"), F.concat(state["out"], F.array(t)).alias("out")))

    def over(state, part):
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), _none(kind).alias("out")), within)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(first["at"].alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    return F.coalesce(F.aggregate(blocks, begin, over, lambda s: F.flatten(s["out"])), _none(kind))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value), in code points, end exclusive.

    Spark has no match positions; they follow from the lengths of the matches and of the text between them.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.transform(found, F.char_length).alias("size"), F.transform(between, F.char_length).alias("gap"), values.alias("value"))
    whole = F.filter(zipped, lambda x: x["size"].isNotNull())

    def placed(items):
        ends = running(items, F.lit(0), lambda at, x: at + x["gap"] + x["size"], "int")
        return F.zip_with(items, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), let(whole, placed)).otherwise(_none(SPAN))


def _weight(n: Column) -> Column:
    """n log2 n, 0 at 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(value: Column, window: int = WINDOW, enough: Column | None = None) -> Column:
    """Largest Shannon entropy, in bits per character, of a window of ``value``; 0 for shorter strings.

    H = log2 W - S / W with S the sum of n log2 n over character counts. The state
    holds the counts of the window's characters and S; a move takes one character out and
    one in, which changes S by those two only. With ``enough``, the search ends at the
    first window that reaches it, and that window's entropy is given.
    """
    bound = F.lit(-math.inf) if enough is None else (F.lit(math.log2(window)) - enough) * window

    def moved(counts, char, by):
        """The counts after ``char`` enters or leaves, and the change of S."""
        had = F.coalesce(F.try_element_at(counts, char), F.lit(0))
        return let(had, lambda n: F.struct(F.map_concat(F.map_filter(counts, lambda k, v: k != char), F.when(n + by > 0, F.create_map(char, n + by)).otherwise(F.expr("cast(map() as map<string,int>)"))).alias("counts"), (_weight(n + by) - _weight(n)).alias("change")))

    def best(chars):
        start = F.struct(F.expr("cast(map() as map<string,int>)").alias("counts"), F.lit(0.0).alias("s"), F.lit(math.inf).alias("low"))

        def step(state, i):
            out = F.when(i < window, F.struct(state["counts"].alias("counts"), F.lit(0.0).alias("change"))).otherwise(moved(state["counts"], F.get(chars, i - window), -1))

            def enter(left):
                return let(moved(left["counts"], F.get(chars, i), 1), lambda now: let(state["s"] + left["change"] + now["change"], lambda s: F.struct(now["counts"].alias("counts"), s.alias("s"), F.when(i >= window - 1, F.least(state["low"], s)).otherwise(state["low"]).alias("low"))))

            return F.when(state["low"] <= bound, state).otherwise(let(out, enter))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda s: s["low"])

    low = let(F.split(value, ""), best)
    return F.when(F.char_length(value) >= window, math.log2(window) - low / window).otherwise(F.lit(0.0))


def entropy_spans(text: Column, window: int = WINDOW, classes: dict = CLASSES, allowed: tuple = ALLOWED) -> Column:
    """Spans of the runs of each class that reach the class's limit, unless the run itself is allow-listed.

    Runs of all classes' characters are cut out first; the classes' own runs lie within
    them. A run of several classes is judged once, by the least of their limits.
    """
    joined = matches(text, f"[{ALPHABET}]{{{window},}}")

    def candidates(x):
        found = []
        for characters, limit in classes.values():
            runs = matches(x["value"], f"[{characters}]{{{window},}}")
            found.append(F.transform(runs, lambda m: F.struct((x["start"] + m["start"]).alias("start"), (-x["start"] - m["end"]).alias("back"), F.lit(limit).alias("limit"), m["value"].alias("value"))))  # noqa: B023
        return F.array_sort(F.concat(*found))

    def first(items):
        same = lambda x, y: (x["start"] == y["start"]) & (x["back"] == y["back"])
        return F.filter(items, lambda x, i: (i == 0) | ~same(x, F.get(items, i - 1)))

    def secret(x):
        listed = F.lit(False)
        for pattern in allowed:
            listed = listed | x["value"].rlike(pattern)
        return F.when(listed, F.lit(False)).otherwise(window_entropy(x["value"], window, x["limit"]) >= x["limit"])

    every = F.flatten(F.transform(joined, lambda x: let(candidates(x), first)))
    return F.transform(F.filter(every, secret), lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end")))


def _outermost(spans: Column) -> Column:
    """``spans`` less the entropy spans that lie within another span."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))

    def kept(items):
        reach = running(items, F.lit(-1), lambda at, x: F.greatest(at, -x["back"]), "int")
        return let(reach, lambda r: F.filter(items, lambda x, i: (x["kind"] < 3) | (F.coalesce(F.get(r, i - 1), F.lit(-1)) < -x["back"])))

    return F.transform(let(order, kept), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["back"]).alias("end")))


def scan(df: DataFrame, text: str = "text", window: int = WINDOW, allowed: tuple = ALLOWED, out: str = "spans") -> DataFrame:
    """Add ``out``: array of (start, kind, end), by start and then kind (0 assign, 1 access, 2 hex, 3 entropy).

    Base kinds are never suppressed; entropy spans are those that lie in no base
    span and in no longer entropy span. Offsets are code points, ends exclusive. Null and empty texts
    have no spans. Whole texts are scanned; rows are independent of each other, so repeated rows
    and ties have equal spans and an empty table gives no rows. A
    column named like ``out`` is replaced, others are kept.
    """
    df = without(df, [out])
    plain = F.coalesce(F.col(text), F.lit(""))
    columns = df.columns
    found = df.select(
        "*",
        F.filter(matches(plain, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= 6).alias("__assign"),
        matches(plain, ACCESS).alias("__access"),
        matches(plain, HEX).alias("__hex"),
        entropy_spans(plain, window, allowed=allowed).alias("__entropy"),
    )

    def of(name: str, kind: int) -> Column:
        return F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    every = F.concat(of("__assign", 0), of("__access", 1), of("__hex", 2), of("__entropy", 3))
    found = found.select(*[F.col(f"`{c}`") for c in columns], every.alias("__every"))
    return found.select(*[F.col(f"`{c}`") for c in columns], F.when(F.size("__every") > 0, F.array_sort(_outermost(F.col("__every")))).otherwise(F.col("__every")).alias(out))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in blocks of ``STRETCH``: only the blocks between are touched."""
    i, j = (start / STRETCH).cast("int"), (end / STRETCH).cast("int")
    head, tail = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
    from_, to = start % STRETCH, end % STRETCH
    middle = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(i == j, F.substr(head, from_ + 1, to - from_)).otherwise(F.concat(F.substr(head, from_ + 1, F.lit(STRETCH)), middle, F.substr(tail, F.lit(1), to)))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``df`` with each span of its text replaced by ``mark``; overlapping spans are one. Columns stay the same.

    Null and empty texts and texts without secrets stay as they are; so does an empty table.
    """

    def replaced(spans, blocks):
        reach = running(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), "int")

        def written(ends):
            # a span that begins within what came before adds nothing
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            parts = F.transform(spans, lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), F.concat(_part(blocks, before(i), x["start"]), F.lit(mark))).otherwise(F.lit("")))
            rest = _part(blocks, F.array_max(ends), F.char_length(text))
            return F.concat(F.array_join(parts, ""), rest)

        return let(reach, written)

    scanned = scan(df, text, out="__spans", **options)
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    clean = let(blocks, lambda b: replaced(F.col("__spans"), b))
    return scanned.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))).select(*[F.col(f"`{c}`") for c in df.columns])
