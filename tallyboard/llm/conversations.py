"""Prefix trie of conversations whose heads come from other conversations.

A rebuilt conversation is the head of its base followed by its own turns after its head.
Texts are never put together: each turn has a hash, and a sequence of turns has a product
in a monoid, the pair (sum of hash * base**place, base**length) modulo a prime, in several
lanes. Products combine, so the fingerprint of every prefix of a rebuilt conversation is
the product of its base's head times that of a stretch of its own turns. The latter are
running sums within chunks of a conversation, to which the products of earlier chunks
are added, so a conversation of any length is spread over tasks.

Prefixes of one depth and fingerprint make a node. Equality is verified, not assumed:
turns of one digest are compared by role and text (different ones get numbers), and a node
is accepted only if all its members come from one parent and refer to one stored turn. By
induction over the depth equal fingerprints then are equal sequences. If any node fails,
all fingerprints get one more lane.

Sums over a subtree need no walk over levels: every node belongs to its smallest member,
which owns a node and all below it on its path from some depth on. So what a subtree holds
is a sum over its members, each with the part of its path that it owns. Hot nodes (the
root has every conversation) are therefore plain sums, combined before they move.

Edge cases: rows without a conv_id take no part. A null role or text counts as empty; a
null turn comes first; turns of one number are ordered by a digest of role and text, and
repeated rows are turns of their own. Conversations rebuilt without turns belong to the
root alone. An empty table has no node, not even the root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.operators.ranking import with_position
from tallyboard.session import materialise

PRIME = (1 << 31) - 1
LANES = 3
#: Turns of a conversation whose running products one task makes.
CHUNK_TURNS = 10_000
#: Most turns a head may have.
MAX_HEAD = 3
_DIGIT = 5
_PLACES = 40  # bits of a place
_WORD = r"[^\x20\x09-\x0D]+"


def turn_digests(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), role, text) for k in (1, 2)]


def _base(lane: int) -> int:
    return pow(7, 1001 + 2 * lane, PRIME)


def _hash(lane: int, prefix: str = "") -> Column:
    parts = [F.col(f"{prefix}{c}") for c in ("digest_1", "digest_2", "chain")]
    return F.pmod(F.xxhash64(F.lit(lane), *parts), F.lit(PRIME))


def _power(lane: int, exponent: Column) -> Column:
    """base**exponent modulo the prime, from tables for five bits at a time."""
    product = None
    for digit in range(_PLACES // _DIGIT):
        step = pow(_base(lane), 1 << (_DIGIT * digit), PRIME)
        table = F.array(*[F.lit(pow(step, k, PRIME)) for k in range(1 << _DIGIT)]).cast("array<long>")
        at = F.shiftright(exponent, _DIGIT * digit).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        factor = F.get(table, at.cast("int"))
        product = factor if product is None else product * factor % PRIME
    return product


@dataclass(frozen=True)
class Product:
    """A product of the monoid in one lane: weighted sum and base**length."""

    total: Column
    shift: Column

    def then(self, other: Product) -> Product:
        return Product(
            (self.total + self.shift * other.total) % PRIME, self.shift * other.shift % PRIME
        )


def _one() -> Product:
    return Product(F.lit(0).cast("long"), F.lit(1).cast("long"))


def numbered_turns(
    conversations: DataFrame,
    digests: Callable[[Column, Column], list[Column]] = turn_digests,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """conv_id, place (from 1), digest_1, digest_2, chain, words: one row per turn.

    ``chain`` tells apart turns that share both digests but differ in role or text.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    first, second = digests(F.col("role"), F.col("text"))
    turns = turns.withColumns({"digest_1": first, "digest_2": second})
    each = turns.select("digest_1", "digest_2", "role", "text").distinct()
    clashing = materialise(
        each.groupBy("digest_1", "digest_2").agg(F.count("*").alias("texts")).filter("texts > 1"),
        "turn-clashes",
    )
    if clashing.isEmpty():
        turns = turns.withColumn("chain", F.lit(0))
    else:
        order = Window.partitionBy("digest_1", "digest_2").orderBy("role", "text")
        chains = each.join(clashing.drop("texts"), ["digest_1", "digest_2"]).withColumn(
            "chain", F.row_number().over(order) - 1
        )
        turns = turns.join(chains, ["digest_1", "digest_2", "role", "text"], "left")
        turns = turns.withColumn("chain", F.coalesce("chain", F.lit(0)))
    narrow = turns.select(
        "conv_id", "turn", "digest_1", "digest_2", "chain",
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), *map(F.col, ("digest_1", "digest_2", "chain"))]
    placed = with_position(narrow, ["conv_id"], order, "place", policy=policy)
    return materialise(placed.drop("turn"), "turns")


def _conversations(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """One row per conversation: conv_id, base, head, turns, own_words and its first turns."""
    first = {
        f"{c}_{k}": F.max(F.when(F.col("place") == k, F.col(name)))
        for k in range(1, MAX_HEAD + 1)
        for c, name in (("a", "digest_1"), ("b", "digest_2"), ("c", "chain"), ("w", "words"))
    }
    return (
        turns.withColumns({"base": base, "head": head})
        .groupBy("conv_id", "base", "head")
        .agg(
            F.count("*").alias("turns"),
            F.sum(F.when(F.col("place") > F.col("head"), F.col("words")).otherwise(0)).alias("own_words"),
            *[column.alias(name) for name, column in first.items()],
        )
    )


def _with_heads(conversations: DataFrame) -> DataFrame:
    """conv_id, head, borrowed (turns from the base), last (depth), total (words) and the
    base's first turns as ``h1_digest_1`` and so on."""
    bases = conversations.select(
        F.col("conv_id").alias("base"),
        F.col("turns").alias("base_turns"),
        *[
            F.col(f"{c}_{k}").alias(f"h{k}_{name}")
            for k in range(1, MAX_HEAD + 1)
            for c, name in (("a", "digest_1"), ("b", "digest_2"), ("c", "chain"), ("w", "words"))
        ],
    )
    borrowed = F.least("head", F.coalesce("base_turns", F.lit(0))).cast("long")
    own = F.greatest(F.col("turns") - F.col("head"), F.lit(0))
    head_words = reduce(
        lambda a, b: a + b,
        [
            F.when(F.col("borrowed") >= k, F.col(f"h{k}_words")).otherwise(0)
            for k in range(1, MAX_HEAD + 1)
        ],
    )
    return (
        conversations.select("conv_id", "base", "head", "turns", "own_words")
        .join(bases, "base", "left")
        .withColumn("borrowed", borrowed)
        .withColumn("head_words", head_words)
        .withColumn("last", F.col("borrowed") + own)
        .withColumn("total", F.col("head_words") + F.col("own_words"))
        .drop("turns", "own_words", "base_turns")
    )


_PREFIX = ("conv_id", "depth", "digest_1", "digest_2", "chain", "words", "before", "turn_conv", "turn_place")


def _lanes(names: str, lanes: int) -> list[str]:
    return [f"{names}{k}" for k in range(lanes)]


def _head_prefixes(heads: DataFrame, lanes: int) -> DataFrame:
    """Prefixes that lie in the base's head, with the root at depth 0."""
    products = [_one() for _ in range(lanes)]
    before = F.lit(0).cast("long")
    rows = []
    for depth in range(MAX_HEAD + 1):
        fields = {
            "depth": F.lit(depth).cast("long"),
            **{f: p.total for f, p in zip(_lanes("mark_", lanes), products)},
            **{f: F.lit(None).cast("long") for f in _lanes("above_", lanes)},
            **{f: F.lit(None).cast("long") for f in ("digest_1", "digest_2")},
            "chain": F.lit(None).cast("int"),
            "words": F.lit(0).cast("long"),
            "before": F.lit(0).cast("long"),
            "turn_conv": F.lit(None).cast("long"),
            "turn_place": F.lit(None).cast("long"),
        }
        if depth:
            turn = f"h{depth}_"
            above = products
            products = [
                p.then(Product(_hash(k, turn), F.lit(_base(k)).cast("long")))
                for k, p in enumerate(above)
            ]
            words = F.col(f"{turn}words")
            fields |= {f: p.total for f, p in zip(_lanes("mark_", lanes), products)}
            fields |= {f: p.total for f, p in zip(_lanes("above_", lanes), above)}
            fields |= {c: F.col(f"{turn}{c}") for c in ("digest_1", "digest_2", "chain")}
            fields |= {
                "words": words, "before": before,
                "turn_conv": F.col("base"), "turn_place": F.lit(depth).cast("long"),
            }
            before = before + words
        rows.append(F.struct(*[c.alias(f) for f, c in fields.items()]))
    taken = F.filter(F.array(*rows), lambda r: r["depth"] <= F.col("borrowed"))
    return heads.select("conv_id", "last", "total", F.inline(taken))


def _own_prefixes(turns: DataFrame, heads: DataFrame, head: Column, longest: int, lanes: int) -> DataFrame:
    """Prefixes that end in a conversation's own turns after its head."""
    own = turns.withColumn("head", head).filter("place > head")
    own = own.withColumn("step", F.col("place") - F.col("head") - 1)
    own = own.withColumn("chunk", F.floor(F.col("step") / CHUNK_TURNS))
    own = own.select("*", *[_hash(k).alias(f"hash_{k}") for k in range(lanes)])
    term = [F.col(f"hash_{k}") * _power(k, F.col("step")) % PRIME for k in range(lanes)]
    own = own.select("*", *[t.alias(f"term_{k}") for k, t in enumerate(term)])
    sums = [*_lanes("term_", lanes), "words"]
    so_far = (
        Window.partitionBy("conv_id", "chunk").orderBy("place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = own.select("*", *[F.sum(c).over(so_far).alias(f"run_{c}") for c in sums])
    if longest > CHUNK_TURNS:
        # the products of a conversation's earlier chunks, one row per chunk
        earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        totals = own.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(c) for c in sums])
        offsets = totals.select(
            "conv_id", "chunk",
            *[F.sum(F.col(c) % PRIME if c != "words" else F.col(c)).over(earlier).alias(f"off_{c}") for c in sums],
        ).filter("chunk > 0")
        run = run.join(offsets, ["conv_id", "chunk"], "left")
        run = run.withColumns(
            {f"run_{c}": F.col(f"run_{c}") + F.coalesce(f"off_{c}", F.lit(0)) for c in sums}
        )
    products = [_one() for _ in range(lanes)]
    ends = products
    for depth in range(1, MAX_HEAD + 1):
        turn = f"h{depth}_"
        products = [
            p.then(Product(_hash(k, turn), F.lit(_base(k)).cast("long"))) for k, p in enumerate(products)
        ]
        taken = F.col("borrowed") >= depth
        ends = [
            Product(F.when(taken, p.total).otherwise(e.total), F.when(taken, p.shift).otherwise(e.shift))
            for p, e in zip(products, ends)
        ]
    starts = heads.select(
        "conv_id", "borrowed", "last", "total", "head_words",
        *[e.total.alias(f"head_{k}") for k, e in enumerate(ends)],
        *[e.shift.alias(f"shift_{k}") for k, e in enumerate(ends)],
    )

    def mark(k: int, total: Column) -> Column:
        start = Product(F.col(f"head_{k}"), F.col(f"shift_{k}"))
        return start.then(Product(F.pmod(total, F.lit(PRIME)), F.lit(1))).total

    return run.join(starts, "conv_id").select(
        "conv_id",
        "last",
        "total",
        (F.col("borrowed") + F.col("step") + 1).alias("depth"),
        *[mark(k, F.col(f"run_term_{k}")).alias(f"mark_{k}") for k in range(lanes)],
        *[
            mark(k, F.col(f"run_term_{k}") - F.col(f"term_{k}")).alias(f"above_{k}")
            for k in range(lanes)
        ],
        "digest_1",
        "digest_2",
        "chain",
        "words",
        (F.col("head_words") + F.col("run_words") - F.col("words")).alias("before"),
        F.col("conv_id").alias("turn_conv"),
        F.col("place").alias("turn_place"),
    )


@dataclass(frozen=True)
class Trie:
    """``nodes``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_words and the stored turn it ends with (turn_conv, turn_place);
    ``ends``: node (conv_id, depth) at which each conversation (member) ends."""

    nodes: DataFrame
    ends: DataFrame


def trie(
    conversations: DataFrame,
    base: Column,
    head: Column,
    digests: Callable[[Column, Column], list[Column]] = turn_digests,
    lanes: int = LANES,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> Trie:
    """The trie of conversations rebuilt from ``head`` (up to three) turns of ``base``,
    both expressions over conv_id."""
    turns = numbered_turns(conversations, digests, policy)
    each = materialise(_conversations(turns, base, head), "conversations")
    heads = materialise(_with_heads(each), "heads")
    longest = each.agg(F.max("turns")).first()[0] or 0
    while True:
        mark, above = _lanes("mark_", lanes), _lanes("above_", lanes)
        key = ["depth", *mark]
        own = _own_prefixes(turns, heads, head, longest, lanes)
        prefixes = materialise(
            _head_prefixes(heads, lanes).unionByName(own), "prefixes"
        )
        said = [*above, "digest_1", "digest_2", "chain"]
        nodes = materialise(
            prefixes.groupBy(*key).agg(
                F.min("conv_id").alias("conv_id"),
                F.count("*").alias("n_convs"),
                F.max("before").alias("before"),
                F.min_by("turn_conv", "conv_id").alias("turn_conv"),
                F.min_by("turn_place", "conv_id").alias("turn_place"),
                *[F.min(c).alias(c) for c in said],
                *[F.max(c).alias(f"other_{c}") for c in said],
            ),
            "nodes",
        )
        differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in said])
        if nodes.filter(differ).isEmpty():
            break
        lanes += 1
    return Trie(*_measured(prefixes, nodes, mark, above))


def _measured(prefixes: DataFrame, nodes: DataFrame, mark: list[str], above: list[str]):
    key = ["depth", *mark]
    children = (
        nodes.filter("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), *[F.col(a).alias(m) for a, m in zip(above, mark)])
        .agg(F.count("*").alias("n_children"))
    )
    nodes = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # from which word on a conversation owns the nodes on its path, and whether a leaf is its own
    owners = nodes.groupBy("conv_id").agg(
        F.min("before").alias("owned_from"),
        F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"),
    )
    rest = F.col("total") - F.col("before")
    owned = F.when(
        F.col("owned_from").isNull(), F.lit(0)
    ).otherwise(F.col("total") - F.greatest("before", "owned_from"))
    sums = (
        prefixes.select("conv_id", *key, "before", "total")
        .join(owners, "conv_id", "left")
        .groupBy(*key)
        .agg(
            F.sum(rest - owned).alias("saved_words"),
            F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        )
    )
    measured = nodes.join(sums, key)
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        *[F.col(m).alias(a) for a, m in zip(above, mark)],
        F.col("conv_id").alias("parent_conv_id"),
    )
    found = measured.join(parents, ["depth", *above], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_words", "turn_conv", "turn_place",
    )
    last = prefixes.filter("depth = last").select(F.col("conv_id").alias("member"), *key)
    return found, last.join(nodes.select("conv_id", *key), key).select("conv_id", "depth", "member")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after the other, joined by commas."""
    node, state = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            at = (row["conv_id"], row["depth"])
            if at != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = at, hashlib.sha256(row["piece"].encode())
            else:
                state.update(b"," + row["piece"].encode())
        if out:
            yield _digests(out)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, sha = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())],
        ["conv_id", "depth", "ends_sha256"],
    )


def member_digests(ends: DataFrame, piece_bits: int = 16) -> DataFrame:
    """conv_id, depth, ends_sha256 of the members that end at each node, ascending.

    Members are joined in pieces of at most 2**piece_bits ids; a node with more than one
    piece is hashed piece by piece.
    """
    pieces = materialise(
        ends.groupBy("conv_id", "depth", F.shiftright("member", piece_bits).alias("part"))
        .agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("piece")),
        "members",
    )
    several = pieces.groupBy("conv_id", "depth").agg(F.count("*").alias("parts")).filter("parts > 1")
    several = several.drop("parts")
    single = pieces.join(several, ["conv_id", "depth"], "left_anti").select(
        "conv_id", "depth", F.sha2(F.col("piece").cast("binary"), 256).alias("ends_sha256")
    )
    streamed = (
        pieces.join(several, ["conv_id", "depth"], "left_semi")
        .repartition("conv_id", "depth")
        .sortWithinPartitions("conv_id", "depth", "part")
        .mapInArrow(_hash_pieces, "conv_id long, depth long, ends_sha256 string")
    )
    return single.unionByName(streamed)


def describe(found: Trie) -> DataFrame:
    """The columns of the query."""
    none = hashlib.sha256(b"").hexdigest()
    return found.nodes.join(member_digests(found.ends), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_words").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def block_base() -> Column:
    """The first conversation of each twenty."""
    return F.col("conv_id") - F.col("conv_id") % 20


def hashed_head() -> Column:
    """Zero to three turns, by a hash of the id."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return describe(trie(rows, block_base(), hashed_head()))


SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda a, bit: xor(a >> 1, (a & 1) * 3988292384)), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS head
  FROM (SELECT DISTINCT conv_id FROM t)),
own AS (
  SELECT c.conv_id, 1 AS part, t.place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > head),
lent AS (
  SELECT c.conv_id, 0 AS part, t.place, role, text FROM c JOIN t ON t.conv_id = base AND t.place <= head),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text
  FROM (SELECT * FROM own UNION ALL SELECT * FROM lent)),
p AS (
  SELECT conv_id, depth, text, list({'role': role, 'text': text}) OVER (
           PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)::VARCHAR AS path
  FROM r UNION ALL SELECT conv_id, 0, '', '' FROM c),
l AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
n AS (
  SELECT depth, path, min(p.conv_id) AS conv_id, count(*) AS n_convs,
         len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS words,
         string_agg(CASE WHEN depth = last THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id) AS ends
  FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY depth, path),
-- a member of a node, and the node above it on the path of the same conversation
up AS (
  SELECT DISTINCT a.depth, a.path, b.path AS above
  FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1),
m AS (
  SELECT n.*, u.above, x.conv_id AS parent_conv_id
  FROM n LEFT JOIN up u ON u.depth = n.depth AND u.path = n.path
  LEFT JOIN n x ON x.depth = n.depth - 1 AND x.path = u.above),
k AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
-- every node below (or at) a node, once
s AS (
  SELECT DISTINCT a.depth, a.path, b.depth AS below, b.path AS sub
  FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
w AS (
  SELECT s.depth, s.path, sum((n.n_convs - 1) * n.words) AS saved,
         count(*) FILTER (k.n_children IS NULL) AS leaves
  FROM s JOIN n ON n.depth = s.below AND n.path = s.sub
  LEFT JOIN k ON k.depth = s.below AND k.path = s.sub
  GROUP BY s.depth, s.path)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, coalesce(k.n_children, 0) AS n_children,
       w.leaves AS n_leaves, w.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN w ON w.depth = m.depth AND w.path = m.path
LEFT JOIN k ON k.depth = m.depth AND k.path = m.path
"""
