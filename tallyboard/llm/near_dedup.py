"""N-gram Jaccard join with a token-group matrix.

Tokens are distinct word shingles. Two documents link when their sets reach a Jaccard
similarity, and then each shares that share of its own tokens with the other. So any
two linked sets have a token in common among the first ``n - ceil(s * n) + 1`` of each
in any one order of all tokens (their leading tokens). The order puts rare tokens
first: tokens frequent in a sample of documents come last, so passages that many
documents share seldom lead. The sample only changes the amount of work.

1. Sets that are equal become one node.
2. The matrix of leading tokens: all nodes of a token meet in one task. Each node is
   compared with the node it shares most leading tokens with, which partitions similar
   documents into groups: the components of the links found.
3. Groups that share a leading token across groups are candidates. A group's token
   union is stored as counts of its distinct tokens in buckets; two groups are opened
   only if the bound on their overlap, summed over the buckets, reaches what a link
   needs. In opened groups, nodes that share a leading token are compared.
4. Components of all links.

Hot tokens are dealt out by token and node, so no task gets all nodes of a token that
very many documents hold. Whole sets move only to be compared.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing.
Texts with fewer words than a shingle have their whole sequence as the only token. A
null doc_id takes part; a component takes the smallest id it has, null if it has none.
Rows that repeat a document are one node and each get its component. Very long texts
count whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm import words
from tallyboard.llm.columns import order_of, packed, unpacked
from tallyboard.session import materialise

SHINGLE = 5
#: Jaccard similarity, in per cent, that links two documents.
PERCENT = 80
#: Documents drawn by a hash to find frequent tokens, and how many of them make one.
SAMPLE_DOCS = 8192
FREQUENT = 3
#: Tasks that share the nodes of a frequent token.
SALTS = 16
#: Postings a task holds before it hands them on.
LOT_POSTINGS = 500_000
#: Members compared with one node in one task.
MEMBERS = 256
#: Nodes of a token beyond which candidates stay in packed arrays.
WIDE = 50
#: Nodes of a token that one task holds against as many others.
BLOCK = 1024
#: Buckets of a set's token counts, and of the brief counts that lists carry.
BUCKETS, BRIEF = 256, 64

_SHIFT = np.random.default_rng(8).integers(1, 1 << 63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    hashes, _, counts = words.hashed([(t or b"").lower() for t in texts])
    out = []
    ends = np.cumsum(counts)
    size = len(hashes) - SHINGLE + 1
    if size > 0:
        runs = np.zeros(size, np.uint64)
        for k in range(SHINGLE):
            runs += hashes[k : k + size] * _SHIFT[k]
        runs = words.mix(runs)
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(runs[end - n : end - SHINGLE + 1]))
        elif n:
            short = np.append(hashes[end - n : end] * _SHIFT[:n], _SHIFT[SHINGLE] << np.uint64(n))
            out.append(words.mix(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = words.mix(tokens ^ _SHIFT[0]).sum(dtype=np.uint64, keepdims=True)
    return int(words.mix(total ^ np.uint64(len(tokens))).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def bucket_counts(tokens: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Tokens in each bucket of the hash, up to 255, which stands for any more."""
    shift = np.uint64(65 - buckets.bit_length())
    held = np.bincount((tokens >> shift).astype(np.int64), minlength=buckets)
    return np.minimum(held, 255).astype(np.uint8)


def overlap_bounds(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Upper bounds on the tokens a set shares with each of many, by bucket counts."""
    both = np.minimum(one[None], many).astype(np.int64)
    both[both == 255] = 1 << 40
    return both.sum(axis=1)


def _may_link(bound: np.ndarray, n: np.ndarray, least: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap bound allows a link of sets of n and at least ``least`` tokens."""
    return (100 + percent) * bound >= percent * (n + least)


def leading(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first tokens of a set in the common order, of which linked sets share one."""
    n = len(tokens)
    size = n + (-percent * n) // 100 + 1  # n - ceil(percent * n / 100) + 1
    names, often = frequent
    if not len(names):
        return tokens[:size]
    at = np.searchsorted(names, tokens)
    at[at == len(names)] = 0
    times = np.where(names[at] == tokens, often[at], 0)
    return tokens[np.argsort(times, kind="stable")[:size]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    ).withColumn("text", F.col("text").cast("binary"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1024):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        sets = shingle_sets(part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("text_key"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([bucket_counts(s).tobytes() for s in sets], pa.binary()),
                pa.array([bucket_counts(s, BRIEF).tobytes() for s in sets], pa.binary()),
            ],
            ["doc_id", "text_key", "n", "node", "buckets", "brief"],
        )


def document_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, node (null for an empty set), buckets and brief of every row,
    written once."""
    ddl = "doc_id long, text_key long, n long, node long, buckets binary, brief binary"
    return materialise(_texts(docs).mapInArrow(_nodes, ddl), "nodes")


def frequent_tokens(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several sampled documents and how many; a bounded sample bounds them."""
    share = F.lit(min(1.0, SAMPLE_DOCS / max(1, rows)) * 1_000_000)
    drawn = _texts(docs).filter(F.pmod("text_key", F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        for part in _parts(batches):
            for tokens in shingle_sets(part.column("text").to_pylist()):
                node = node_of(tokens)
                if node not in seen:
                    seen.add(node)
                    held.append(tokens)
        if held:
            names, times = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at : at + 100_000].view(np.int64)), pa.array(times[at : at + 100_000])],
                    ["token", "times"],
                )

    counted = (
        drawn.mapInArrow(count, "token long, times long")
        .groupBy("token")
        .agg(F.sum("times").alias("times"))
        .filter(F.col("times") >= FREQUENT)
        .toArrow()
    )
    names = counted.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], counted.column("times").to_numpy()[order].astype(np.int32)


_LISTS_DDL = "token long, node long, n int, hot boolean"


def token_lists(docs: DataFrame, frequent, percent: int = PERCENT) -> DataFrame:
    """token, node, n, hot: the leading tokens that several nodes hold, written once.

    Postings travel as packed arrays, one per task and target.
    """
    spark = docs.sparkSession
    targets = _targets(docs)
    shared = spark.sparkContext.broadcast(frequent)
    record = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("hot", "u1")])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value[0]
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def blocks() -> pa.RecordBatch:
            rows = np.concatenate(held)
            spread = rows["token"] ^ np.where(
                rows["hot"] > 0, rows["node"].view(np.uint64) % np.uint64(SALTS) + np.uint64(1), np.uint64(0)
            )
            target = (words.mix(spread ^ _SHIFT[2]) % np.uint64(targets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            rows, cuts = rows[order], np.searchsorted(target[order], np.arange(targets + 1))
            used = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([rows[cuts[t] : cuts[t + 1]].tobytes() for t in used], pa.binary()),
                ],
                ["target", "postings"],
            )

        for part in _parts(batches):
            for tokens in shingle_sets(part.column("text").to_pylist()):
                if not len(tokens):
                    continue
                node = node_of(tokens)
                if node in seen:
                    continue
                seen.add(node)
                first = leading(tokens, shared.value, percent)
                rows = np.empty(len(first), record)
                rows["token"], rows["node"], rows["n"] = first, node, len(tokens)
                at = np.searchsorted(names, first)
                at[at == len(names)] = 0
                rows["hot"] = names[at] == first if len(names) else 0
                held.append(rows)
                size += len(rows)
                if size >= LOT_POSTINGS:
                    yield blocks()
                    held, size = [], 0
        if held:
            yield blocks()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(p, record) for b in batches for p in b.column("postings").to_pylist()]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.lexsort((rows["node"], rows["token"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
        rows = rows[new]
        begins = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
        sizes = np.diff(np.append(begins, len(rows)))
        # a hot token's other nodes may be in other tasks
        rows = rows[np.repeat(sizes > 1, sizes) | (rows["hot"] > 0)]
        for at in range(0, len(rows), 100_000):
            some = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(some["token"]).view(np.int64)),
                    pa.array(np.ascontiguousarray(some["node"])),
                    pa.array(np.ascontiguousarray(some["n"])),
                    pa.array(some["hot"] > 0),
                ],
                ["token", "node", "n", "hot"],
            )

    posted = _texts(docs).mapInArrow(post, "target int, postings binary")
    return materialise(
        posted.repartitionById(targets, "target").mapInArrow(collect, _LISTS_DDL), "lists"
    )


def representatives(nodes: DataFrame, *columns: str) -> DataFrame:
    """node and columns of the document (text_key, doc_id, buckets, brief) that stands
    for it."""
    return (
        nodes.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct("text_key", "doc_id", *columns)).alias("of"))
        .select("node", *[f"of.{c}" for c in columns or ("text_key", "doc_id")])
    )


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, keys: tuple, ddl: str) -> DataFrame:
    """The columns of ``keys``, node and tokens: a node's set for each of its ``asked``.

    Texts of the nodes' representatives are found by hash and id; everything else of
    the documents only passes through that join.
    """
    wanted = materialise(
        asked.join(representatives(nodes), "node").select(
            "node", "asked", "text_key", F.col("doc_id").alias("_id")
        ),
        "asked",
    )
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in ddl.split(", ")] + [pa.int64(), pa.binary()]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), types)], [*keys, "node", "tokens"]
        )

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 256):
            rows = []
            sets = shingle_sets(part.column("text").to_pylist())
            uses = part.column("asked").to_pylist()
            for node, tokens, own in zip(part.column("node").to_pylist(), sets, uses):
                raw = tokens.tobytes()
                for use in own:
                    rows.append((*(use[k] for k in keys), node, raw))
                    if len(rows) >= 512:
                        yield rows_of(rows)
                        rows = []
            if rows:
                yield rows_of(rows)

    return (
        _texts(docs)
        .join(wanted, ["text_key"])
        .filter(F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("node", "text", "asked")
        .mapInArrow(with_sets, f"{ddl}, node long, tokens binary")
    )


def compare(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pivot, node, linked for distinct pairs of nodes, written once.

    The pivot's set goes once to every ``MEMBERS`` of its members.
    """
    held = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(held, "pivot").select(
        "node",
        "pivot",
        F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"),
        F.lit(True).alias("member"),
    )
    pivots = held.select(
        F.col("pivot").alias("node"),
        "pivot",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(False).alias("member"),
    )
    asked = (
        members.unionByName(pivots)
        .groupBy("node")
        .agg(F.collect_list(F.struct("pivot", "salt", "member")).alias("asked"))
    )
    sets = _sets(
        docs, nodes, asked, ("pivot", "salt", "member"), "pivot long, salt int, member boolean"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for part in _parts(batches):
            out = []
            for pivot, salt, member, node, raw in zip(*(c.to_pylist() for c in part.columns)):
                tokens = np.frombuffer(raw, np.uint64)
                if not member:
                    at, own = (pivot, salt), tokens
                elif at == (pivot, salt):
                    out.append((pivot, node, linked(own, tokens, percent)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out)], ["pivot", "node", "linked"]
                )

    checked = (
        sets.repartition("pivot", "salt")
        .sortWithinPartitions("pivot", "salt", "member")
        .mapInArrow(check, "pivot long, node long, linked boolean")
    )
    return materialise(checked, "compared")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of the edges (a, b).

    Large-star and small-star in turns; each round is written to the shared folder.
    """
    now = materialise(edges.filter("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).filter("a <> b").distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        now = materialise(small, "small-star")
        after = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if after == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def likeliest(lists: DataFrame) -> DataFrame:
    """pivot, node: each node with the node it shares most leading tokens with, of those
    that come first in a token's list."""
    first = lists.groupBy("token").agg(F.min("node").alias("pivot"), F.count("*").alias("held"))
    first = materialise(first.filter("held > 1").select("token", "pivot"), "firsts")
    shared = (
        lists.join(first, "token")
        .filter("node <> pivot")
        .groupBy("node", "pivot")
        .agg(F.count("*").alias("times"))
    )
    return shared.groupBy("node").agg(
        F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot")
    ).select("pivot", "node")


def across(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """token, node, n, component, held: the matrix of tokens and groups, where a token
    is in several groups. ``held`` counts its nodes. Written once."""
    placed = lists.join(groups, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    placed = materialise(placed.select("token", "node", "n", "component"), "placed")
    several = (
        placed.groupBy("token")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count("*").alias("held"),
        )
        .filter("low < high")
        .select("token", "held")
    )
    several = materialise(several, "several")
    return materialise(placed.join(several, "token"), "across")


def _runs(batches: Iterator[pa.RecordBatch], keys: int):
    """Columns of all rows with the same first ``keys`` columns, which arrive sorted."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(column[start].item() for column in columns)
            if held and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _short_lists(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of other groups within each token, as far as sizes and brief counts
    allow a link; the lesser node first."""
    if not len(table):
        return
    token, node, n, component = (
        table.column(c).to_numpy() for c in ("token", "node", "n", "component")
    )
    brief = _grid(table.column("brief"), BRIEF)
    found: list[np.ndarray] = []
    for apart in range(1, min(WIDE, len(token))):
        one = np.flatnonzero(token[:-apart] == token[apart:])
        if not len(one):
            break
        two = one + apart
        fits = (
            (component[one] != component[two])
            & (100 * n[one] >= percent * n[two])
            & (100 * n[two] >= percent * n[one])
        )
        one, two = one[fits], two[fits]
        for at in range(0, len(one), 100_000):
            i, j = one[at : at + 100_000], two[at : at + 100_000]
            both = np.minimum(brief[i], brief[j]).astype(np.int32)
            both[both == 255] = 1 << 24
            keep = _may_link(both.sum(axis=1, dtype=np.int64), n[i].astype(np.int64), n[j], percent)
            pairs = np.column_stack([node[i][keep], node[j][keep]])
            found.append(np.column_stack([pairs.min(axis=1), pairs.max(axis=1)]))
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["pivot", "node"]
            )


def _targets(df: DataFrame) -> int:
    """Shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def candidates(matrix: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pivot, node: nodes of different groups that share a leading token of no more than
    ``WIDE`` nodes, and that the bounds allow to link."""
    buckets = representatives(nodes, "buckets")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                table = pa.Table.from_batches(held).combine_chunks()
                tokens = table.column("token").to_numpy()
                # the last token may have more rows to come
                cut = int(np.searchsorted(tokens, tokens[-1]))
                yield from _short_lists(table.slice(0, cut), percent)
                held, rows = table.slice(cut).to_batches(), len(tokens) - cut
        if rows:
            yield from _short_lists(pa.Table.from_batches(held).combine_chunks(), percent)

    few = (
        matrix.filter(F.col("held") <= WIDE)
        .join(representatives(nodes, "brief"), "node")
        .select("token", "node", "n", "component", "brief")
        .repartition("token")
        .sortWithinPartitions("token")
        .mapInArrow(narrow, "pivot long, node long")
        .distinct()
    )
    # the bound of a pair, as each of the two may be in many short lists
    few = (
        few.join(buckets.withColumnsRenamed({"node": "pivot", "buckets": "_one"}), "pivot")
        .join(buckets.withColumnRenamed("buckets", "_two"), "node")
        .join(_sizes(nodes, "pivot", "_n"), "pivot")
        .join(_sizes(nodes, "node", "_m"), "node")
        .select("pivot", "node", "_one", "_two", "_n", "_m")
    )

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            if not part.num_rows:
                continue
            one, two = (_grid(part.column(c)) for c in ("_one", "_two"))
            both = np.minimum(one, two).astype(np.int64)
            both[both == 255] = 1 << 40
            n, m = (part.column(c).to_numpy() for c in ("_n", "_m"))
            keep = _may_link(both.sum(axis=1), n, m, percent)
            yield part.select(["pivot", "node"]).filter(pa.array(keep))

    return few.mapInArrow(bound, "pivot long, node long")


def wide_links(
    docs: DataFrame, matrix: DataFrame, nodes: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """a, b: links that connect nodes of different groups which share a token of many
    nodes, enough of them to connect all that link. Written once.

    A job is a token and two blocks of its nodes. It first bounds the overlaps of its
    groups and opens those that may link; only the nodes in question then send their
    sets to the job. Pairs of nodes belong to the first such token they share.
    """
    many = matrix.filter(F.col("held") > WIDE)
    tokens = many.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = (
        many.join(representatives(nodes, "buckets"), "node")
        .join(tokens, "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "token",
            F.least("own", "other").alias("one"),
            F.greatest("own", "other").alias("two"),
            "node",
            "n",
            "component",
            "buckets",
            "tokens",
        )
    )

    def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            pairs = _open_groups(run, percent)
            if len(pairs):
                key = [run.column(c)[0].as_py() for c in ("token", "one", "two")]
                asked = np.unique(pairs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key[0]], pa.int64()),
                        pa.array([key[1]], pa.int32()),
                        pa.array([key[2]], pa.int32()),
                        pa.array([asked.tolist()], pa.list_(pa.int64())),
                        pa.array([pairs.tobytes()], pa.binary()),
                    ],
                    ["token", "one", "two", "nodes", "pairs"],
                )

    jobs = materialise(
        dealt.repartition("token", "one", "two")
        .sortWithinPartitions("token", "one", "two")
        .mapInArrow(
            open_groups, "token long, one int, two int, nodes array<long>, pairs binary"
        ),
        "jobs",
    )
    asked = (
        jobs.select("token", "one", "two", F.explode("nodes").alias("node"))
        .groupBy("node")
        .agg(F.collect_list(F.struct("token", "one", "two")).alias("asked"))
    )
    sets = _sets(docs, nodes, asked, ("token", "one", "two"), "token long, one int, two int")
    rows = sets.unionByName(
        jobs.select(
            "token", "one", "two", F.lit(None).cast("long").alias("node"), F.col("pairs").alias("tokens")
        )
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            held = dict(zip(run.column("node").to_pylist(), run.column("tokens").to_pylist()))
            pairs = np.frombuffer(held.pop(None), np.int64).reshape(-1, 2)
            found = _spanning(pairs, {k: np.frombuffer(v, np.uint64) for k, v in held.items()}, percent)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"]
                )

    checked = (
        rows.repartition("token", "one", "two")
        .sortWithinPartitions("token", "one", "two")
        .select("token", "one", "two", "node", "tokens")
        .mapInArrow(check, "a long, b long")
    )
    return materialise(checked, "wide")


def _spanning(pairs: np.ndarray, sets: dict[int, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the pairs; a pair that others already connect is left out."""
    root: dict[int, int] = {}

    def find(node: int) -> int:
        while root.setdefault(node, node) != node:
            root[node] = root[root[node]]
            node = root[node]
        return node

    found = []
    for a, b in pairs.tolist():
        one, two = find(a), find(b)
        if one != two and linked(sets[a], sets[b], percent):
            root[one] = two
            found.append((a, b))
    return found


def _sizes(nodes: DataFrame, name: str, size: str) -> DataFrame:
    return nodes.filter("node IS NOT NULL").groupBy(F.col("node").alias(name)).agg(
        F.max("n").alias(size)
    )


def _grid(column, buckets: int = BUCKETS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, buckets)


def _open_groups(run: pa.Table, percent: int) -> np.ndarray:
    """Pairs of nodes in those pairs of groups whose bounds allow a link, the likeliest
    first, if this run's token is the first wide one they share."""
    node, n, component = (run.column(c).to_numpy() for c in ("node", "n", "component"))
    token = run.column("token")[0].as_py()
    earlier = [{t for t in own if t < token} for own in run.column("tokens").to_pylist()]
    order = np.argsort(component, kind="stable")
    node, n, component = node[order], n[order], component[order]
    earlier = [earlier[k] for k in order.tolist()]
    held = _grid(run.column("buckets"))[order]
    begins = np.flatnonzero(np.append(True, component[1:] != component[:-1]))
    ends = np.append(begins[1:], len(node))
    # a group's union in a bucket bounds what any member has there
    unions = np.maximum.reduceat(held, begins, axis=0)
    least = np.minimum.reduceat(n, begins)
    most = np.maximum.reduceat(n, begins)
    pairs, bounds = [], []
    for k in range(len(begins) - 1):
        later = np.flatnonzero(
            (100 * most[k + 1 :] >= percent * least[k]) & (100 * most[k] >= percent * least[k + 1 :])
        ) + k + 1
        if not len(later):
            continue
        bound = overlap_bounds(unions[k], unions[later])
        opened = later[_may_link(bound, least[k], least[later], percent)]
        if not len(opened):
            continue
        theirs = np.concatenate([np.arange(begins[g], ends[g]) for g in opened.tolist()])
        for i in range(begins[k], ends[k]):
            bound = overlap_bounds(held[i], held[theirs])
            fits = np.flatnonzero(_may_link(bound, n[i], n[theirs], percent))
            for at in fits.tolist():
                j = int(theirs[at])
                if earlier[i].isdisjoint(earlier[j]):
                    pairs.append((int(node[i]), int(node[j])))
                    bounds.append(bound[at] / (n[i] + n[j]))
    if not pairs:
        return np.empty((0, 2), np.int64)
    return np.array(pairs, np.int64)[np.argsort(-np.array(bounds), kind="stable")]


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, node of every row."""
    nodes = document_nodes(docs)
    lists = token_lists(docs, frequent_tokens(docs, nodes.count()), percent)
    first = materialise(likeliest(lists), "likeliest")
    tried = compare(docs, nodes, first, percent)
    edges = tried.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    groups = materialise(components(edges), "groups")
    matrix = across(lists, groups)
    known = tried.select(
        F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")
    )
    more = materialise(
        candidates(matrix, nodes, percent).join(known, ["pivot", "node"], "left_anti"), "candidates"
    )
    found = [wide_links(docs, matrix, nodes, percent)]
    if not more.isEmpty():
        found.append(
            compare(docs, nodes, more, percent)
            .filter("linked")
            .select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        )
    for more_edges in found:
        edges = edges.unionByName(more_edges)
    groups = materialise(components(edges), "groups")
    placed = nodes.drop("buckets", "brief").join(groups, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    # written, so that a join with a large component can be split
    least = materialise(
        placed.filter("node IS NOT NULL")
        .groupBy("component")
        .agg(F.min("doc_id").alias("component_id")),
        "least",
    )
    return placed.join(least, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias(
            "component_id"
        ),
        "text_key",
        "component",
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents of which one of each group stays, all columns whatever their names: the
    one with the least id, then the least hash of its text. Empty sets all stay. Of rows that
    repeat id and text, the one whose other columns come first as JSON stays."""
    placed = materialise(join(docs, percent), "joined")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    alone = placed.filter("component IS NULL").select("doc_id", "text_key").distinct()
    stays = (
        placed.filter("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min(order).alias("first"))
        .select("first.doc_id", "first.text_key")
        .unionByName(alone)
        .select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_text"))
    )
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        packed(docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(text).alias("key"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        order_of(docs, ("doc_id", "text")).alias("others"),
    )
    joined = keyed.join(
        stays, (F.col("key") == F.col("kept_text")) & F.col("id").eqNullSafe(F.col("kept_id"))
    )
    # rows that repeat an id and a text with words are one document
    same = Window.partitionBy("key", "id").orderBy("others")
    return (
        joined.withColumn("nth", F.row_number().over(same))
        .filter("nth = 1 OR blank")
        .select(*unpacked(docs.columns, "row"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join(docs).select("doc_id", "n_shingles", "component_id")
