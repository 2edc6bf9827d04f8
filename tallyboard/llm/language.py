"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to an order, with counts of the bytes
that followed each context in a sample of its texts. A context that saw T bytes, D of
them distinct, gives a byte seen n times the probability n / (T + D) and keeps
D / (T + D) for an escape to the context one byte shorter, which shares it out among
the bytes not seen here; below the empty context all 256 bytes are alike. The counts
are frozen, so the code length of a byte depends on the bytes before it alone, and is
looked up in a table: whole texts are scored as arrays. The language that codes the
text in the fewest bits is predicted.

Bytes that no language saw behave alike in every context, so they share one symbol.
Letters are lower-cased first.

The sample is drawn in pieces, so it is bounded however long the texts are, and every
language with a text to learn from has a part in it.

Edge cases: a null text, an empty one and one without a letter are ``und`` with score
0; so is every text if there is nothing to learn from. Of languages that code a text
equally well the first by code point wins. Rows with a null lang or text teach
nothing. Repeated rows count each time. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.columns import named

#: Bytes before a byte that may predict it.
ORDER = 3
#: About so many characters of each language are learnt from, drawn by a hash.
SAMPLE_CHARS = 1_000_000
#: Texts are drawn in pieces of so many characters.
PIECE_CHARS = 1000
#: The score is the share of the evidence of so many bytes that is for the language.
SCORE_BYTES = 48
UNKNOWN = "und"
#: Columns of a prediction.
PREDICTED = ("lang_pred", "score", "bits_per_byte")
_PREDICTED_DDL = "lang_pred string, score double, bits_per_byte double"
#: Contexts of the full order seen less often than this are left out of the trees.
MIN_SEEN = 6
#: Bytes of a text scored at a time.
_LOT_BYTES = 50_000


def held_out(doc_id: Column) -> Column:
    """Documents nothing may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _folded(text: Column) -> Column:
    return F.lower(text).cast("binary")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The drawn pieces of each text, each with the characters before it."""
    for batch in batches:
        out: list[tuple[str, str, str]] = []
        columns = (batch.column(c).to_pylist() for c in ("lang", "text", "drawn"))
        for lang, text, drawn in zip(*columns):
            for k in drawn:
                at = k * PIECE_CHARS
                out.append((lang, text[max(0, at - ORDER) : at], text[at : at + PIECE_CHARS]))
        if out:
            names = ["lang", "lead", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names)


def sample(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, lead, text and copies: pieces of about ``chars`` characters per language in
    all, drawn by a hash, with the characters before each and how often it was drawn.

    Of every language the piece with the least hash is among them. Pieces of rows that
    repeat an id and a text share a hash; they are counted, not kept each.
    """
    last = F.greatest(F.ceil(F.length("text") / PIECE_CHARS).cast("int"), F.lit(1)) - 1
    rows = labelled.select(
        "lang",
        "text",
        # the text is hashed once, not for each piece
        F.transform(
            F.array(F.xxhash64("doc_id", "text")),
            lambda own: F.transform(
                F.sequence(F.lit(0), last),
                # 62 bits of a hash as a share
                lambda k: F.shiftrightunsigned(F.xxhash64(own, k), 2) / F.lit(2.0**62),
            ),
        )[0].alias("shares"),
    ).filter("text <> ''")
    sizes = rows.groupBy("lang").agg(
        F.sum(F.length("text")).alias("held"), F.min(F.array_min("shares")).alias("least")
    )
    below = F.greatest(F.lit(float(chars)) / F.col("held"), F.col("least"))
    # a row per language
    drawn = rows.join(F.broadcast(sizes), "lang").select(
        "lang",
        "text",
        F.filter(
            F.transform("shares", lambda share, k: F.when(share <= below, k)),
            lambda k: k.isNotNull(),
        ).alias("drawn"),
    )
    pieces = drawn.filter(F.size("drawn") > 0).mapInArrow(
        _pieces, "lang string, lead string, text string"
    )
    return pieces.groupBy("lang", "lead", "text").agg(F.count("*").alias("copies"))


def _windows(data: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it as one number; where the text has
    fewer, 256 stands for each byte missing. Nine bits a byte."""
    size = len(data)
    place = np.arange(size) - np.repeat(begins, np.diff(np.append(begins, size)))
    out = data.astype(np.uint64)
    for back in range(1, order + 1):
        before = np.full(size, 256, np.uint64)
        before[back:] = data[:-back] if size > back else 0
        before[place < back] = 256
        out |= before << np.uint64(9 * back)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language's windows within a task. A piece's lead is context only."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lang", "lead", "text", "copies"))
        for lang, lead, text, copies in zip(*columns):
            if text:
                data = np.frombuffer(lead + text, np.uint8)
                own = _windows(data, np.zeros(1, np.int64), ORDER)[len(lead) :]
                held.setdefault(lang, []).append((own, np.full(len(own), copies)))
    for lang, parts in held.items():
        windows, of = np.unique(np.concatenate([own for own, _ in parts]), return_inverse=True)
        counts = np.zeros(len(windows), np.int64)
        np.add.at(counts, of, np.concatenate([copies for _, copies in parts]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(windows), pa.string()),
                pa.array(windows.astype(np.int64)),
                pa.array(counts, pa.int64()),
            ],
            ["lang", "seen", "n"],
        )


@dataclass
class Model:
    """Code lengths for all languages.

    symbols: 256 bytes to symbols (0: seen nowhere), and 256 (none) to the last one.
    pairs: the deepest node for each pair of symbols (one and two bytes back).
    children: for each node the node one byte deeper, or itself.
    bits: code length by node, symbol and language.
    """

    langs: list[str]
    symbols: np.ndarray
    pairs: np.ndarray
    children: np.ndarray
    bits: np.ndarray

    def score(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Bits of each text by language. Texts stand one after the other; none is empty."""
        total = np.zeros((len(begins), len(self.langs)))
        none, width = self.symbols[256], self.bits.shape[1]
        symbols = self.symbols[data]
        for start in range(0, len(data), _LOT_BYTES):
            end = min(len(data), start + _LOT_BYTES)
            back = []
            for k in (1, 2, 3):
                own = np.full(end - start, none, symbols.dtype)
                lead = max(0, k - start)
                own[lead:] = symbols[start + lead - k : end - k]
                # a byte near its text's begin has no context beyond it
                near = begins[(begins > start - k) & (begins < end)]
                for step in range(k):
                    at = near + step - start
                    own[at[(at >= 0) & (at < end - start)]] = none
                back.append(own.astype(np.int64))
            nodes = self.pairs[back[0] * (none + 1) + back[1]]
            nodes = self.children[nodes * (none + 1) + back[2]].astype(np.int64)
            bits = self.bits.reshape(-1, len(self.langs))[nodes * width + symbols[start:end]]
            first = np.searchsorted(begins, start, "right") - 1
            until = np.searchsorted(begins, end, "left")
            cuts = np.maximum(begins[first:until], start) - start
            total[first:until] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return total

    def choose(self, bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score for each text, by bits and bytes."""
        behind = (bits - bits.min(axis=1, keepdims=True)) / sizes[:, None]
        weight = np.exp2(-behind * np.minimum(sizes, SCORE_BYTES)[:, None])
        return bits.argmin(axis=1), weight.max(axis=1) / weight.sum(axis=1)


def build(counts: list[tuple[str, int, int]]) -> Model | None:
    """The model from (lang, window, count) of all languages."""
    if not counts:
        return None
    langs = sorted({lang for lang, _, _ in counts})
    of = {lang: k for k, lang in enumerate(langs)}
    lang = np.array([of[c[0]] for c in counts])
    seen = np.array([c[1] for c in counts], np.int64)
    n = np.array([c[2] for c in counts], np.float64)
    columns = [(seen >> (9 * k)) & 511 for k in range(ORDER + 1)]
    alphabet = np.unique(columns[0])
    symbols = np.zeros(257, np.int16)
    symbols[alphabet] = np.arange(1, len(alphabet) + 1)
    symbols[256] = none = len(alphabet) + 1
    size = len(alphabet) + 1  # symbols that can be coded; 0 stands for all unseen bytes
    unseen = 256 - len(alphabet)
    column = [symbols[c].astype(np.int64) for c in columns]
    # the empty context: counts of bytes, escaping to 256 equal ones
    base = np.full((len(langs), size), 1 / 256, np.float32)
    base[:, 0] = unseen / 256
    levels: list[np.ndarray] = []  # by context, language and byte
    names: list[np.ndarray] = []
    for depth in range(ORDER + 1):
        known = np.ones(len(seen), bool)
        name = np.zeros(len(seen), np.int64)
        for k in range(1, depth + 1):
            known &= column[k] != none
            name = name * (none + 1) + column[k]
        contexts, row = np.unique(name[known], return_inverse=True)
        if depth == ORDER:
            often = np.bincount(row, n[known], len(contexts)) >= MIN_SEEN
            known[known] = often[row]
            contexts, row = np.unique(name[known], return_inverse=True)
        above = np.searchsorted(names[-1], contexts // (none + 1)) if depth else 0
        level = np.empty((len(contexts), len(langs), size), np.float32)
        for k in range(len(langs)):
            own = lang[known] == k
            table = np.zeros((len(contexts), size), np.float32)
            np.add.at(table, (row[own], column[0][known][own]), n[known][own])
            total = table.sum(axis=1, keepdims=True)
            distinct = (table > 0).sum(axis=1, keepdims=True)
            parent = levels[-1][above, k] if depth else base[None, k]
            left = np.where(table > 0, 0, parent)
            shared = left.sum(axis=1, keepdims=True)
            # where every byte was seen nothing is left to escape to
            distinct = np.where(shared > 0, distinct, 0)
            table += distinct * left / np.where(shared > 0, shared, 1)
            level[:, k] = np.where(total > 0, table / np.maximum(total + distinct, 1), parent)
        levels.append(level)
        names.append(contexts)
    first = np.cumsum([0] + [len(level) for level in levels])
    probabilities = np.concatenate(levels)
    # an unseen byte takes an equal share of what all of them have
    probabilities[:, :, 0] /= max(1, unseen)
    with np.errstate(divide="ignore"):
        bits = -np.log2(probabilities)
    bits = np.ascontiguousarray(bits.transpose(0, 2, 1), np.float32)
    children = np.repeat(np.arange(first[-1], dtype=np.int32)[:, None], none + 1, axis=1)
    for depth in range(1, ORDER + 1):
        parent = np.searchsorted(names[depth - 1], names[depth] // (none + 1))
        children[first[depth - 1] + parent, names[depth] % (none + 1)] = first[depth] + np.arange(
            len(names[depth])
        )
    one, two = np.divmod(np.arange((none + 1) ** 2), none + 1)
    node = children[0, one]
    pairs = np.where(node == 0, 0, children[node, two]).astype(np.int32)
    # only nodes of two bytes lead deeper
    children[: first[2]] = np.arange(first[2], dtype=np.int32)[:, None]
    return Model(langs, symbols, pairs, children.reshape(-1), bits)


def fit(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> list[tuple[str, int, int]]:
    """Counts of a bounded sample: (lang, window, count), at most a row per character
    drawn."""
    drawn = sample(labelled, chars).select(
        "lang",
        _folded(F.col("lead")).alias("lead"),
        _folded(F.col("text")).alias("text"),
        "copies",
    )
    counted = drawn.mapInArrow(_count, "lang string, seen long, n long")
    rows = counted.groupBy("lang", "seen").agg(F.sum("n").alias("n")).toArrow()
    return sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "seen", "n"))))


def _free(name: str, columns: list[str]) -> str:
    """The name, behind as many underscores as it takes to be none of the columns'."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    chars: int = SAMPLE_CHARS,
    names: tuple[str, str, str] = PREDICTED,
) -> DataFrame:
    """All columns of the documents with lang_pred, score and bits_per_byte, or with
    other names for these; columns of the same names are replaced.

    ``labelled`` holds doc_id, text and lang of the rows to learn from.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    # bounded by the sample: a table of contexts, symbols and languages
    shared = docs.sparkSession.sparkContext.broadcast(build(fit(known, chars)))

    def predict(folded: bytes | None) -> tuple[str, float, float | None]:
        model = shared.value
        if not folded or not model:
            return UNKNOWN, 0.0, None
        bits = model.score(np.frombuffer(folded, np.uint8), np.zeros(1, np.int64))
        best, score = model.choose(bits, np.array([len(folded)]))
        return model.langs[best[0]], float(score[0]), float(bits[0, best[0]] / len(folded))

    # A worker gets a hundred folded texts at a time and returns what was predicted; the rows
    # stay where they are. Arrow batches would hold up to 64 MB of rows several times over.
    # Said to be non-deterministic, it isn't called again for a filter of the prediction.
    predicted = F.udf(predict, _PREDICTED_DDL, useArrow=False).asNondeterministic()
    clash = {c for c in docs.columns if c.lower() in {n.lower() for n in names}}
    plain = docs.drop(*clash)
    own = _free("_predicted", plain.columns)
    letters = F.when(F.col("text").rlike(r"\p{L}"), _folded(F.col("text")))
    return plain.withColumn(own, predicted(letters)).select(
        *[named(c) for c in plain.columns],
        *[F.col(own).getField(kind).alias(name) for kind, name in zip(PREDICTED, names)],
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a language, all columns as they were."""
    labelled = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    # by number, so that names may hold dots and be those of a prediction
    numbered = docs.select(
        *[
            named(c).alias(c.lower() if c.lower() in ("doc_id", "text") else f"column_{k}")
            for k, c in enumerate(docs.columns)
        ]
    )
    found = identify(numbered, labelled).filter(F.col(PREDICTED[0]) != UNKNOWN)
    return found.select(*[F.col(n).alias(c) for n, c in zip(numbered.columns, docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(texts, labelled).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte"
    )
