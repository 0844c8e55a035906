"""N-gram Jaccard join with prefix filters under several global orders.

A document's set holds its distinct shingles of ``width`` words. Documents with
equal sets are one node. If two sets reach the similarity, their first tokens
(the prefix, about (1 - similarity) of the set) under any fixed order of all
tokens have one in common. Candidates are made under one order and must share
prefix neighbours and prefix tokens under two more orders before they are verified:

1. Every order puts rare tokens first: tokens that are frequent in some batch go
   last, by magnitude, then by hash. Orders 2 and 3 use other hashes. Any order
   gives right results, so that the estimate of the frequencies is not critical.
2. Order 1 is cut into runs at fixed places, in proportion to a size class. Each run
   that two sets don't have in common holds a difference, so among as many runs as
   there may be differences, and one more, is a common one: these first runs that a
   set has are its prefix. Each makes a group, by its tokens and the size class. A run
   holds several tokens; unrelated sets, however long, hardly share one by chance. Sizes
   that can't reach the similarity hardly meet. Groups of a single node are dropped: a
   bitmap of fixed size tells the tasks which groups may have more.
3. In each group the node with the earliest place is the pivot. Every node is
   compared with one pivot, the one it shares the most groups with: a pair per
   node at most. Verified links give components.
4. Groups that still hold several components are open. Of open groups with the same
   nodes only one stays. If many pairs of nodes would meet in them, the nodes of open
   groups choose their prefixes anew under another order: a pair has to share runs under
   the order before and under this one. This is repeated, ORDERS times at most.
5. In what is open then, the nodes that are not of a group's largest component meet
   all others, in parts of PART nodes. A pair leaves the join in the first of its common
   groups alone: each node has its FIRST smallest open groups with it, and if two nodes
   have some of these in common, the smallest of them is the smallest that they share.
   (A pair without one leaves it in each; such pairs share few of their groups.) Sketches
   of a set bound the difference of a pair from below, inside the join, and drop what
   can't link: the parities of the token counts of BITS hash classes (sets that differ in
   d tokens differ in nearly d of them, while d is small against BITS), of FINE_BITS for
   sets of FINE_FROM tokens or more, and the counts of CLASSES coarser ones. Links found
   here join components further.

So a large group of copies costs a row each, not all pairs, and yet no link
between different components is lost. Verification intersects whole sets of
64-bit shingle hashes. Staged tables go as soon as no later step reads them.

Defined results: null or empty texts and texts of white space have no shingles
and link with nothing; fewer words than ``width`` are one shingle; repeated
rows are reported each; rows without a doc_id are left out; an empty table gives no
rows; very long texts are read whole, a block of texts at a time; columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import (Words, arrow_map, bit_sketch, blocks, components, drop_staged, in_sketch, longs, maybe_in,
                                 mix, mixed_id, most_frequent, pieces, stage_table, texts)

HOT_SHARE = 1 / 2000      # of the documents; only moves a token in the orders
HOT_TOKENS = 1 << 18      # the most frequent ones that are moved (a bound of the broadcast)
GROUP_BITS = 1 << 26
ORDERS = 3                # times that open groups are made anew at most
PAIRS = 200               # pairs per document that may meet without a new order
PART = 512                # nodes of an open group that others meet in one task
HOT_COPIES = 200          # sets that more than 1 / HOT_COPIES of the documents have are joined in parts
CLASSES = 32              # hash classes of the count vector
BITS = 1024               # hash classes of the parities
FINE_BITS = 4096          # and of those that longer sets have besides
FINE_FROM = 1024          # tokens of such sets
FIRST = 16                # smallest open groups that a node has with it
SKETCHES = ("counts", "parities", "fine")
SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def _sets(batch: pa.RecordBatch, width: int):
    """(place in the batch, sorted distinct shingle hashes) of each text."""
    for b in blocks(batch.column("text")):
        words = Words(b)
        for k, row in enumerate(b.rows):
            yield row, np.unique(words.shingles(k, width))


def _parities(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether the number of tokens is odd, by hash class, packed into longs."""
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fingerprint(tokens: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([np.add.reduce(mix(tokens)) + np.uint64(len(tokens))], np.uint64))[0]


def _levels(tokens: np.ndarray, hot: np.ndarray, magnitude: np.ndarray) -> np.ndarray:
    """0, or of frequent tokens the magnitude."""
    if not len(hot):
        return np.zeros(len(tokens), np.uint64)
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    return np.where(hot[at] == tokens, magnitude[at], np.uint64(0))


def _ordered(tokens: np.ndarray, k: int, hot: np.ndarray, magnitude: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` tokens under order k."""
    key = mix(tokens ^ np.uint64(SALTS[k])) >> np.uint64(6) | _levels(tokens, hot, magnitude) << np.uint64(58)
    return tokens[np.argsort(key, kind="stable")[:length]]


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _in_pairs(percent: int) -> bool:
    """Whether sets that may link and differ have two common tokens more than
    differences, so that neighbours can make the groups."""
    return percent >= 75


def _starts(n: int, percent: int) -> int:
    """Places of an order whose tokens, or from each of which two neighbours, are compared.
    Before the first common neighbours of A and B there are at most d differences and so
    at most d common tokens, and the sum of d and of those in A is at most
    2 * (1 - similarity) * |A|."""
    return min(2 * (100 - percent) * n // 100 + 1, n - 1) if _in_pairs(percent) else _prefix_length(n, percent)


def _neighbours(prefix: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of each two neighbours of a prefix (or its tokens)."""
    return mix(prefix[:-1] * np.uint64(0xD6E8FEB86659FD93) + prefix[1:]) if _in_pairs(percent) else prefix


def _size_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, its largest size) of the one or two size classes of a set.

    A class is some steps of the similarity wide (a little more, for rounding), less than
    a doubling. A size in its last step belongs to the next class too, so that any two
    sizes that may link share one."""
    steps = max(2, int(np.log(1.9) / np.log(100 / percent)))
    wide = steps * float(np.log(100 / percent * 1.0005))
    size = float(np.log(n)) / wide
    c = int(size)
    return [(k, int(np.exp((k + 1) * wide)) + 1) for k in (c, c + 1)[:1 + (size - c >= 1 - 1 / steps - 1e-9)]]


def _cuts(top: int, percent: int) -> int:
    """Runs that a level of order 1 is cut into, for sets of up to ``top`` tokens: so
    few that a run holds several tokens, so many that a set has more runs than it may
    have differences."""
    return int(top * (100 - percent) / ((0.95 if _in_pairs(percent) else 0.5) * percent)) + 5


def _documents(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (token null): n, fp, counts, parities, fine (parities of longer
    sets, else null); and one per part of a batch and token that is frequent in it
    (doc_id null): token, n."""
    def run(batch: pa.RecordBatch):
        for piece in pieces(batch):
            yield from some(piece)

    def some(batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        n, fp, counts, parities, fine, seen = [], [], [], [], [], []
        for _, t in _sets(batch, width):
            n.append(len(t))
            fp.append(_fingerprint(t) if len(t) else 0)
            c = np.bincount((t >> np.uint64(59)).astype(np.int64), minlength=CLASSES)
            counts.append(np.minimum(c, 127).astype(np.int8))
            parities.append(_parities(t))
            fine.append(_parities(t, FINE_BITS) if len(t) >= FINE_FROM else None)
            seen.append(t)

        def lists(xs, size):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * size + 1, size), pa.int32()), pa.array(np.concatenate(xs)))
        none = pa.nulls
        schema = ["doc_id", "token", "n", "fp", "counts", "parities", "fine"]
        yield pa.RecordBatch.from_arrays(
            [ids, none(len(n), pa.int64()), pa.array(n, pa.int64()), longs(np.array(fp, np.uint64)),
             lists(counts, CLASSES), lists(parities, BITS // 64), pa.array(fine, pa.list_(pa.int64()))], schema)
        token, count = np.unique(np.concatenate(seen), return_counts=True)
        often = count >= max(4, HOT_SHARE * len(n))
        if often.any():
            m = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [none(m, pa.int64()), longs(token[often]), longs(count[often]), none(m, pa.int64()),
                 none(m, pa.list_(pa.int8())), none(m, pa.list_(pa.int64())), none(m, pa.list_(pa.int64()))], schema)
    return arrow_map(docs, run, "doc_id long, token long, n long, fp long, counts array<tinyint>, parities array<long>, fine array<long>")


def _hot_tokens(rows: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens, magnitude) of at most HOT_TOKENS frequent tokens."""
    got = most_frequent(rows.groupBy("token").agg(F.sum("n").alias("n"))
                        .where(F.col("n") >= max(4, HOT_SHARE * n_docs / 2)), HOT_TOKENS)
    token = got["token"].to_numpy().astype(np.int64).view(np.uint64)
    magnitude = np.minimum(np.log2(np.maximum(got["n"].to_numpy(), 1)).astype(np.uint64) + np.uint64(1), np.uint64(63))
    order = np.argsort(token)
    return token[order], magnitude[order]


def _grouped_runs(batch: pa.RecordBatch, width: int, percent: int, hot, magnitude, order: int = 0):
    """(group, fp, n, place) arrays of order 1 (``order`` > 0: of another one), a group
    per run of the prefix and size class; equal sets of a batch once. Sets so small that
    only equal ones reach the similarity have no rows.

    Of two sets that link, each run that is not the same in both holds one of their d
    differences. So before the first common run either has at most d runs, and its first
    d + 1 runs are the prefix. A set that hasn't got as many is in one more group of its
    class, where it meets the others of this kind."""
    least = -(-percent // (100 - percent))
    out, done = [], set()
    for _, t in _sets(batch, width):
        n = len(t)
        if n < least:
            continue
        fp = _fingerprint(t)
        if fp in done:
            continue
        done.add(fp)
        place = t if order == 0 else mix(t ^ np.uint64(SALTS[0] + order))
        level = _levels(t, hot, magnitude)
        value = mix(place)
        place = place >> np.uint64(26 + 6)
        if order or level.any():  # else they are sorted
            by = np.argsort(level << np.uint64(58) | place, kind="stable")
            place, level, value = place[by], level[by], value[by]
        for c, top in _size_classes(n, percent):
            cuts = np.uint64(_cuts(top, percent))
            run = level * cuts + (place * cuts >> np.uint64(32))
            most = (100 - percent) * (n + min(100 * n // percent, top)) // (100 + percent)
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            end = starts[most + 1] if len(starts) > most + 1 else n
            salt = mix(np.array([c + 1], np.uint64))
            group = mix(np.add.reduceat(value[:end], starts[:most + 1]) + salt)
            if len(starts) <= most:
                group = np.concatenate([group, mix(salt)])
            out.append((group, np.full(len(group), fp, np.uint64), np.full(len(group), n), np.arange(len(group))))
    if not out:
        return None
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _group_sizes(docs: DataFrame, *how) -> DataFrame:
    """(grp): the groups of each batch, those with several of its sets twice."""
    def run(batch: pa.RecordBatch):
        for piece in pieces(batch, 1000):
            rows = _grouped_runs(piece, *how)
            if rows:
                group, n = np.unique(rows[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([longs(np.repeat(group, np.minimum(n, 2)))], ["grp"])
    return arrow_map(docs, run, "grp long")


def _group_sketch(groups: DataFrame) -> np.ndarray:
    """A bitmap of ``groups`` (grp), two places each."""
    return bit_sketch(groups.select(F.explode(F.array("grp", F.shiftrightunsigned("grp", 32))).alias("k")), "k", GROUP_BITS)


def _in_groups(sketch: np.ndarray, groups: np.ndarray) -> np.ndarray:
    maybe = in_sketch(sketch, groups)
    maybe[maybe] = in_sketch(sketch, groups[maybe] >> np.uint64(32))
    return maybe


def _group_rows(docs: DataFrame, sketch: np.ndarray | None, *how) -> DataFrame:
    """(grp, fp, n, place) of the groups that may have several sets; without a
    sketch, of all."""
    def run(batch: pa.RecordBatch):
        for piece in pieces(batch, 1000):
            rows = _grouped_runs(piece, *how)
            if rows:
                keep = slice(None) if sketch is None else _in_groups(sketch, rows[0])
                group, fp, n, place = (x[keep] for x in rows)
                yield pa.RecordBatch.from_arrays([longs(group), longs(fp), pa.array(n.astype(np.int32)),
                                                  pa.array(place.astype(np.int32))], ["grp", "fp", "n", "place"])
    return arrow_map(docs, run, "grp long, fp long, n int, place int")


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int, percent: int, hot, magnitude) -> DataFrame:
    """(fp, p2, p3, tokens): the sets of ``nodes`` (fp, rep) and their prefixes
    under orders 2 (neighbours) and 3 (half of each hash: equal tokens stay equal),
    from the texts of their first documents. Some sets of other nodes come along, and a
    node may have several equal rows."""
    sketch = bit_sketch(nodes.select(mixed_id("rep").alias("k")), "k")

    def run(batch: pa.RecordBatch):
        batch = batch.filter(pa.array(in_sketch(sketch, batch.column("k").to_numpy())))
        for piece in pieces(batch, 500):
            yield from some(piece)

    def some(batch: pa.RecordBatch):
        rows = {_fingerprint(t): t for _, t in _sets(batch, width) if len(t)}
        if not rows:
            return
        sets = list(rows.values())

        def lists(xs, values):
            ends = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values(np.concatenate(xs)))
        def halves(x):
            return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))
        two = [_neighbours(_ordered(t, 1, hot, magnitude, _starts(len(t), percent) + _in_pairs(percent)), percent) for t in sets]
        pre = [lists(two, halves),
               lists([_ordered(t, 2, hot, magnitude, _prefix_length(len(t), percent)) for t in sets], halves)]
        yield pa.RecordBatch.from_arrays([longs(np.array(list(rows), np.uint64)), *pre, lists(sets, longs)],
                                         ["fp", "p2", "p3", "tokens"])
    return arrow_map(docs.withColumn("k", mixed_id()), run, "fp long, p2 array<int>, p3 array<int>, tokens array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, percent: int, hot, magnitude) -> DataFrame:
    """The pairs (a, b) of nodes that reach the similarity. Those that share no
    prefix neighbours under order 2 or no prefix token under order 3 go before any set is compared."""
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    nodes = stage_table(spark, nodes.join(reps.select("fp", "rep"), "fp"), "nodes")
    sets = stage_table(spark, _sets_of(docs, nodes, width, percent, hot, magnitude), "sets")

    def side(x, *cols):
        return sets.select(F.col("fp").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in cols])
    near = (pairs.join(side("b", "p2", "p3"), "b").join(side("a", "p2", "p3"), "a")
            .where(F.arrays_overlap("a_p2", "b_p2") & F.arrays_overlap("a_p3", "b_p3")).select("a", "b").distinct())
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = F.size("a_tokens") + F.size("b_tokens")
    links = stage_table(spark, near.join(side("b", "tokens"), "b").join(side("a", "tokens"), "a")
                        .where((100 + percent) * common >= percent * both).select("a", "b"), "verified")
    drop_staged(nodes, sets)
    return links


def _open_rows(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """The staged rows of groups that hold several components: grp, fp, n, place, label,
    and of the group n_nodes, major (its largest component) and pairs (of nodes
    of different components). Of groups with the same nodes only the one with the
    smallest places is left; same nodes are told by two 64-bit sums of their hashes."""
    labelled = grouped.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")).distinct()
    # most groups are closed or have one node: they go before anything is summed up
    mixed = (labelled.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo <> hi").select("grp"))
    labelled = stage_table(grouped.sparkSession, labelled.join(mixed, "grp"), "labelled")
    open_groups = (labelled.groupBy("grp", "label").agg(
                       F.count("*").alias("m"), F.sum("place").alias("places"),
                       F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"))
                   .groupBy("grp").agg(F.sum("m").alias("n_nodes"), F.max_by("label", F.struct("m", "label")).alias("major"),
                                       F.sum(F.col("m") * F.col("m")).alias("same"),
                                       F.sum("places").alias("places"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
                   .groupBy("x", "y", "n_nodes").agg(
                       F.min(F.struct("places", "grp", "major", F.expr("(n_nodes * n_nodes - same) div 2").alias("pairs")))
                       .alias("g"))
                   .select("g.grp", "n_nodes", "g.major", "g.pairs"))
    rows = stage_table(grouped.sparkSession, labelled.join(open_groups, "grp"), "open")
    drop_staged(labelled)
    return rows


def _may_link(a: str, b: str, percent: int):
    return 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")


def _bounded(percent: int):
    """Whether the sketches of a pair (a_, b_) differ little enough."""
    odd = sum((F.bit_count(F.col("a_parities")[i].bitwiseXOR(F.col("b_parities")[i])) for i in range(1, BITS // 64)),
              F.bit_count(F.col("a_parities")[0].bitwiseXOR(F.col("b_parities")[0])))

    def total(values):
        return F.aggregate(values, F.lit(0), lambda s, x: s + x)
    apart = total(F.zip_with("a_counts", "b_counts", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    fine = F.coalesce(total(F.zip_with("a_fine", "b_fine", lambda x, y: F.bit_count(x.bitwiseXOR(y)))), F.lit(0))
    most = (100 - percent) * (F.col("a_n") + F.col("b_n"))
    return ((100 + percent) * odd <= most) & ((100 + percent) * apart <= most) & ((100 + percent) * fine <= most)


def _pairs_in_groups(left: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes of different components that meet in the open groups
    ``left`` and may link, nearly all of them once."""
    parts = F.ceil(F.col("n_nodes") / PART).cast("int")
    first = left.groupBy("fp").agg(F.slice(F.sort_array(F.collect_list("grp")), 1, FIRST).alias("first"))
    sized = left.join(reps.select("fp", *SKETCHES).join(first, "fp"), "fp")

    def side(rows, x, *more):
        return rows.select("grp", "part", *more, *[F.col(c).alias(f"{x}_{c}") for c in ("fp", "n", "label", "first", *SKETCHES)])
    minor = side(sized.where("label <> major").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), "a")
    other = side(sized.withColumn("part", F.pmod("fp", parts).cast("int")), "b", "major")
    # two nodes of different components meet once in each group that both are in
    met = (minor.join(other, ["grp", "part"])
           .where((F.col("a_label") != F.col("b_label")) & ((F.col("b_label") == F.col("major")) | (F.col("a_fp") < F.col("b_fp")))
                  & _may_link("a_", "b_", percent)
                  & (F.coalesce(F.array_min(F.array_intersect("a_first", "b_first")), F.col("grp")) >= F.col("grp"))
                  & _bounded(percent)))
    return met.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))


def _by_copies(rows: DataFrame, hot: DataFrame, spread: str | None) -> DataFrame:
    """``rows`` with ``part``: sets that very many documents have are dealt out
    over several parts, by the column ``spread``, or are in each of them."""
    rows = rows.join(F.broadcast(hot), "fp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = (F.pmod(F.xxhash64(spread), F.col("parts")).cast("int") if spread
            else F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("part", part).drop("parts")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, its own included) and n_copies (documents with the
    same set)."""
    spark = docs.sparkSession
    docs = texts(docs)
    rows = stage_table(spark, _documents(docs, width), "documents")
    per_doc = rows.where("token is null")
    n_docs = per_doc.count()
    hot, magnitude = _hot_tokens(rows.where("token is not null"), n_docs)
    reps = stage_table(spark, per_doc.where("n > 0").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n").alias("n"),
        F.any_value("counts").alias("counts"), F.any_value("parities").alias("parities"), F.any_value("fine").alias("fine")), "reps")

    how = (width, percent, hot, magnitude)
    # nearly all groups have one set: shuffled as they are, not summed up before in every task
    several = _group_sizes(docs, *how).repartition("grp").groupBy("grp").count().where("count > 1")
    sketch = _group_sketch(several)
    # a set that several batches have is several equal rows
    grouped = stage_table(spark, _group_rows(docs, sketch, *how), "groups")

    # Pivots. Nodes with long prefixes look at an eighth of their groups, which are
    # plenty for copies to meet; what this leaves out is found below.
    key = ["grp"]
    some = grouped.where((F.pmod(F.col("grp"), F.lit(8)) == 0) | (F.col("n") < 100))
    pivots = (some.groupBy(*key).agg(F.min(F.struct("place", "n", "fp")).alias("p"), F.max("fp").alias("hi"), F.min("fp").alias("lo"))
              .where("lo <> hi").select(*key, F.col("p.fp").alias("p_fp"), F.col("p.n").alias("p_n"),
                                        F.col("p.place").alias("p_place")))
    # of its pivots a node is compared with the one that it shares the most groups with
    stars = (some.join(pivots, key).where((F.col("fp") != F.col("p_fp")) & _may_link("", "p_", percent))
             .groupBy("fp", "p_fp").agg(F.count("*").alias("shared"))
             .groupBy("fp").agg(F.max_by("p_fp", F.struct("shared", "p_fp")).alias("p_fp"))
             .select(F.least("fp", "p_fp").alias("a"), F.greatest("fp", "p_fp").alias("b")).distinct())

    def of(x):
        return reps.select(F.col("fp").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in (*SKETCHES, "n")])
    stars = stars.join(of("a"), "a").join(of("b"), "b")
    stars = stage_table(spark, stars.where(_bounded(percent)).select("a", "b"), "stars")
    links = _verified(docs, stars, reps, width, percent, hot, magnitude)
    labels = stage_table(spark, components(spark, links), "labels")
    drop_staged(links)

    # what is left: groups with several components
    left = _open_rows(grouped, labels)
    drop_staged(grouped)
    for order in range(1, ORDERS + 1):
        if (left.select("grp", "pairs").distinct().agg(F.sum("pairs")).first()[0] or 0) <= PAIRS * n_docs:
            break
        open_docs = bit_sketch(left.select("fp").distinct().join(reps.select("fp", "rep"), "fp")
                               .select(mixed_id("rep").alias("k")), "k")
        of_open = docs.where(maybe_in(open_docs, mixed_id()))
        again = stage_table(spark, _group_rows(of_open, None, *how, order)
                            .join(left.select("fp").distinct(), "fp", "left_semi").select("grp", "fp", "n", "place"), "groups")
        before, left = left, _open_rows(again, labels)
        drop_staged(before, again)

    # written before the anti-join, which the planner would else put before the bound
    near = stage_table(spark, _pairs_in_groups(left, reps, percent).distinct(), "near")
    met = stage_table(spark, near.join(stars, ["a", "b"], "left_anti"), "met")
    drop_staged(near)
    drop_staged(left, stars)
    more = _verified(docs, met, reps, width, percent, hot, magnitude)
    joined = stage_table(spark, components(spark, more.union(labels.where("node <> label").select(
        F.col("node").alias("a"), F.col("label").alias("b")))), "labels")
    drop_staged(met, more, labels)

    of_node = (joined.withColumnRenamed("node", "fp").join(reps.select("fp", "rep"), "fp"))
    smallest = of_node.groupBy("label").agg(F.min("rep").alias("component"))
    node = (reps.select("fp", "rep", "copies").join(of_node.select("fp", "label").join(smallest, "label"), "fp", "left")
            .select("fp", "copies", F.coalesce("component", "rep").alias("component")))
    # less than HOT_COPIES sets
    hot_sets = (reps.where(F.col("copies") * HOT_COPIES > n_docs)
                .select("fp", F.ceil(F.col("copies") * HOT_COPIES / n_docs).cast("int").alias("parts")))
    each = per_doc.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("fp"))
    return (_by_copies(each, hot_sets, "doc_id").join(_by_copies(node, hot_sets, None), ["fp", "part"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                    F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies")))
