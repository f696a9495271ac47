"""A Merkle manifest of a document table, kept as a log in postorder.

Every language has a tree of eight branches over its leaves, the subroots have one tree above them. A builder owns an aligned run of
``ARITY ** HEIGHT`` leaves: it makes all nodes of that subtree and writes them in the order in which they are complete, children before
parents. The whole log of a tree with n leaves is in that order as well, so the place of any node follows
from the sizes of the subtrees before it (:func:`position`), and a sibling is addressed without any index.

The builders of the next round take the runs' tops as leaves, until one node is left: three rounds for 64 billion leaves of one language.
A proof reads a run's log for its lower levels, and that of the run above for the next ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .frames import sized
from .text_stats import remainder

ARITY, HEIGHT = 8, 4
RUN, BITS = ARITY**HEIGHT, 3
PATH = "array<struct<left:string,right:string>>"
#: Leaves of a range in which their order is found, and equal leaves that one task writes out.
RANGE = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, as lower-case hexadecimal text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def spelled(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def position(level: int | Column, index: Column, leaves: Column) -> Column:
    """Place in the postorder log of node ``index`` of ``level`` in a tree of ``leaves`` leaves.

    Before the node's last leaf stand all leaves and full subtrees that end before it; after that leaf its ancestors are
    complete one level after the other, in a cut-off tree as well.
    """
    level = F.lit(level) if isinstance(level, int) else level
    last = F.least(_spread(index + 1, level), leaves.cast("long")) - 1
    return reduce(lambda a, b: a + b, [F.shiftright(last, BITS * k) for k in range(1, 64 // BITS)], last) + level


def _spread(index: Column, level: Column) -> Column:
    """The leaves before node ``index`` of ``level``."""
    return index.cast("long") * F.pow(F.lit(float(ARITY)), level).cast("long")


def _width(leaves: Column, level: Column) -> Column:
    """Nodes of ``level`` over ``leaves`` leaves."""
    return F.ceil(leaves / F.pow(F.lit(float(ARITY)), level)).cast("long")


def siblings(level: Column, index: Column, leaves: Column) -> Column:
    """Log positions of the siblings of node ``index`` of ``level``: a struct of those left and right of it."""
    first = index - index % ARITY
    last = F.least(first + ARITY, _width(leaves, level)) - 1
    places = lambda keep: F.transform(F.filter(F.sequence(first, last), keep), lambda j: position(level, j, leaves))
    return F.struct(places(lambda j: j < index).alias("left"), places(lambda j: j > index).alias("right"))


def _above(below: Column) -> Column:
    """The level above: digests of eight nodes each, the last of what is left."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY)), lambda j: digest(F.array_join(F.slice(below, (j * ARITY + 1).cast("int"), F.lit(ARITY)), "")))


def runs(nodes: DataFrame, keys: list[str], base: int = 0, carried: list[str] | None = None) -> DataFrame:
    """The aligned builders: one row for each run of ``nodes`` (keys, idx, leaves, digest, and ``carried`` columns).

    ``leaves`` are those of the whole tree, nodes lie ``base`` levels above them. Returns keys, run, leaves, ``count`` (nodes
    of the run), ``height``, ``log`` (level, place and digest in completion order), ``top`` and, for ``carried`` columns, ``members``.
    """
    one = F.struct(F.col("idx"), F.col("digest"), *[F.col(c) for c in carried or []])
    held = nodes.withColumn("run", F.expr(f"idx div {RUN}")).groupBy(*keys, "run").agg(F.sort_array(F.collect_list(one)).alias("members"), F.max("leaves").alias("leaves"))
    held = held.withColumn("count", F.size("members").cast("long")).withColumn("l0", F.col("members.digest"))
    # the run of a tree that has no other ends with its root, any other goes up to its full height, be it by single nodes
    root = F.lit(HEIGHT)
    for k in reversed(range(HEIGHT)):
        root = F.when(F.col("count") <= ARITY**k, k).otherwise(root)
    held = held.withColumn("height", F.when(F.col("leaves") <= RUN * ARITY**base, root).otherwise(HEIGHT).cast("long"))
    for k in range(1, HEIGHT + 1):
        held = held.withColumn(f"l{k}", F.when(F.col("height") >= k, _above(F.col(f"l{k - 1}"))).otherwise(F.array().cast("array<string>")))
    node = lambda k: F.transform(f"l{k}", lambda d, j: F.struct(position(k, j, F.col("count")).alias("at"), F.lit(k).alias("level"), j.cast("long").alias("place"), d.alias("digest")))
    order = F.transform(F.sort_array(F.flatten(F.array(*[node(k) for k in range(HEIGHT + 1)]))), lambda n: F.struct(n["level"].alias("level"), n["place"].alias("place"), n["digest"].alias("digest")))
    kept = held.select(*keys, "run", "leaves", "count", "height", *(["members"] if carried else []), order.alias("log"))
    return kept.withColumn("top", F.element_at("log", -1)["digest"])


def _path(at: Column) -> Column:
    """Siblings of leaf ``at`` of a run, read from its log, level by level: structs of the digests left and right, joined."""
    read = lambda places: F.array_join(F.transform(places, lambda p: F.element_at("log", (p + 1).cast("int"))["digest"]), "")

    def beside(level: Column) -> Column:
        found = siblings(level, F.floor(at / F.pow(F.lit(float(ARITY)), level)), F.col("count"))
        return F.struct(read(found["left"]).alias("left"), read(found["right"]).alias("right"))

    return F.when(F.col("height") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("height") - 1), beside)).otherwise(F.array().cast(PATH))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``, an array of siblings (left, right)."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def build(leaves: DataFrame, keys: list[str], carried: list[str] | None = None) -> list[DataFrame]:
    """Runs of all rounds of the trees of each key over ``leaves`` (keys, idx, leaves, digest, carried), written once."""
    rounds = [cut(runs(leaves, keys, 0, carried))]
    while True:
        base = HEIGHT * len(rounds)
        below = rounds[-1].where(F.col("leaves") > ARITY**base)
        if below.isEmpty():
            return rounds
        rounds.append(cut(runs(below.select(*keys, F.col("run").alias("idx"), "leaves", F.col("top").alias("digest")), keys, base)))


def roots(rounds: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, root) of the trees."""
    return reduce(DataFrame.unionByName, [r.where(F.col("leaves") <= RUN * ARITY ** (HEIGHT * k)).select(*keys, F.col("top").alias("root")) for k, r in enumerate(rounds)])


def log(rounds: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, position, level, digest): all nodes of the trees at their places in the postorder log."""
    parts = []
    for k, built in enumerate(rounds):
        each = built.select(*keys, "run", "leaves", F.explode("log").alias("n")).where(F.col("n.level") >= (1 if k else 0))
        index = F.col("run") * F.pow(F.lit(float(ARITY)), HEIGHT - F.col("n.level")).cast("long") + F.col("n.place")
        level = F.col("n.level") + HEIGHT * k
        parts.append(each.select(*keys, position(level, index, F.col("leaves")).alias("position"), level.alias("level"), F.col("n.digest").alias("digest")))
    return reduce(DataFrame.unionByName, parts)


def with_ways(rounds: list[DataFrame], keys: list[str]) -> DataFrame:
    """The runs of the first round with ``rest``, the siblings from their tops up to the root of their key."""
    upper = None
    for k, built in reversed(list(enumerate(rounds))):
        found = built.withColumn("rest", F.array().cast(PATH))
        if upper is not None:
            on = reduce(lambda a, b: a & b, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], F.col("run") == F.col("_idx")])
            found = built.join(upper, on, "left").withColumn("rest", F.coalesce("upper", F.array().cast(PATH))).select(*built.columns, "rest")
        if k == 0:
            return found
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("count") - 1), lambda at: F.struct((F.col("run") * RUN + at).alias("idx"), F.concat(_path(at), F.col("rest")).alias("path")))
        upper = found.select(*[F.col(c).alias(f"_{c}") for c in keys], F.explode(each).alias("n")).select(*[f"_{c}" for c in keys], F.col("n.idx").alias("_idx"), F.col("n.path").alias("upper"))
    raise ValueError("no rounds")


def proven(runs: DataFrame, keys: list[str], of) -> DataFrame:
    """(keys and what ``of`` makes of a leaf and its path): worked out run by run, so that no row carries a run's log along."""
    each = F.transform("members", lambda m, at: of(m, F.concat(_path(at.cast("long")), F.col("rest"))))
    return runs.select(*keys, F.explode(each).alias("n")).select(*keys, "n.*")


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``idx``, their place within ``keys`` by ``order`` (nulls first), and ``leaves``, the rows of the key.

    Equal rows are counted before they travel. Ranges of the order are numbered on their own and begin after those before them.
    """
    cols = rows.columns
    counted = cut(rows.groupBy(*cols).agg(F.count("*").alias("copies")))
    n = counted.count()
    sort = [F.col(c).asc_nulls_first() for c in order]
    ranged = cut(counted.repartitionByRange(max(8, -(-n // RANGE)), *[F.col(c).asc_nulls_first() for c in keys], *sort).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "part").agg(F.sum("copies").alias("sum"))
    by = Window.partitionBy(*keys)
    before = sums.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("part").alias("_part"), (F.sum("sum").over(by.orderBy("part")) - F.col("sum")).alias("begin"), F.sum("sum").over(by).alias("leaves"))
    up_to = Window.partitionBy(*keys, "part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = reduce(lambda a, b: a & b, [F.col("part") == F.col("_part"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]])
    placed = ranged.withColumn("within", F.sum("copies").over(up_to) - F.col("copies")).join(before, on).withColumn("first", F.col("begin") + F.col("within"))
    # copies come out in parts, so that one row's copies aren't one task's
    parts = placed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {RANGE}"))))
    if not counted.where(F.col("copies") > RANGE).isEmpty():
        parts = parts.repartition(*cols, "piece")
    copy = F.explode(F.sequence(F.col("piece") * RANGE, F.least((F.col("piece") + 1) * RANGE, F.col("copies")) - 1))
    return parts.withColumn("copy", copy).select(*cols, (F.col("first") + F.col("copy")).cast("long").alias("idx"), F.col("leaves").cast("long").alias("leaves"))


def manifest(docs: DataFrame, tampered: Column | None = None, change=lambda text: F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``proof_sha256`` is the digest of all siblings on the way to the root, ``folded_root`` what that way makes of the row's leaf
    as it is now: where ``tampered`` holds, of the leaf with its text put through ``change``. ``verified`` tells whether that is the root.

    Null fields are written ``-``, so a null text isn't an empty one. Null ids come first in their language, null
    languages first of all; rows that repeat an id are ordered by their leaves, so equal rows can't be told apart. One row is leaf,
    subroot and root at once and has the digest of nothing as its proof. An empty table gives no rows.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    leaf = digest(*[spelled(c) for c in fields])
    moved = digest(*[spelled(change(c) if n == "text" else c) for n, c in zip(FIELDS, fields, strict=True)])
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select("doc_id", "lang", leaf.alias("digest"), F.when(hit, moved).otherwise(leaf).alias("now"))
    placed = numbered(rows, ["lang"], ["doc_id", "digest", "now"])
    trees = build(placed, ["lang"], ["doc_id", "now"])
    subroots = cut(roots(trees, ["lang"]))
    tops = build(numbered(subroots.select("lang", F.col("root").alias("digest"), F.lit(0).alias("all")), ["all"], ["lang"]), ["all"], ["lang"])
    way = proven(with_ways(tops, ["all"]), ["all"], lambda m, path: F.struct(m["lang"].alias("_lang"), m["digest"].alias("subroot"), path.alias("above")))
    top = sized(cut(way.join(roots(tops, ["all"]), "all").drop("all")))
    whole = with_ways(trees, ["lang"]).join(top, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("rest", F.concat("rest", "above"))

    def of(m: Column, path: Column) -> Column:
        proof = digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
        return F.struct(m["doc_id"].alias("doc_id"), m["digest"].alias("leaf"), proof.alias("proof_sha256"), fold(m["now"], path).alias("folded_root"))

    made = proven(whole, ["lang", "subroot", "root"], of).select("doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
