"""The operators of the llm subpackage against DuckDB, the library or brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from tallyboard.llm import (
    exact_dedup,
    fingerprints,
    language,
    mixing,
    near_dedup,
    packing,
    quality,
    registry,
    token_files,
    tokens,
    url_lists,
    warc,
)

TESTDATA = Path("/root/testdata")
SF = str(TESTDATA / "sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"
LONG = " ".join(f"word{k % 977} of{k % 31}" for k in range(30_000))
ODD = [
    (1, None, None, None, None, 0.5, 7),
    (2, "", "en", "a", 0, None, None),
    (3, "  \n\t ", "en", "a", 5, None, None),
    (4, "one two three four five six", "en", "b", 27, 1.0, 1),
    (4, "one two three four five six", "en", "b", 27, 1.0, 1),
    (5, "One  two three FOUR five six", "en", None, 28, 1.0, 1),
    (6, "onetwothreefourfivesix", None, "b", 22, 1.0, 1),
    (7, LONG, "en", "c", len(LONG), None, None),
    (None, "no id here at all today", "de", "c", 23, None, None),
    (8, "Ünïcödé “quotes” 中文 don't 'stop' 12½", "fr", "a", 40, None, None),
    (9, "1234 5678 !!", "en", "a", 12, None, None),
    (10, "one", "en", "a", 3, None, None),
]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [column[0] for column in want.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


# tokens, token files, packing


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(spark, name):
    encode = tokens.encoder(public_tokenizers.path(name))
    texts = [r.text for r in _documents(spark).collect()] + [r[1] or "" for r in ODD]
    texts += ["'s 'sun I'll 1's''s !'s", " 's", "x\x1cy \x85 z\xa0 ²", "<|endoftext|> a", "a\n\n b ", "\0a"]
    for text, ids in zip(texts, encode.many(texts)):
        assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_found(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>Ünï x<|endoftext|>", "中文<|endoftext|><|endoftext|> ", "<|EndOfText|>"]
    texts += ["<|endoftext|>", "a <| endoftext|> b", "before", "\n <|endoftext|>\n 12½ <|startoftext|"]
    for text, ids in zip(texts, tokens.encoder(path).many(texts)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert plain.token_to_id("<|endoftext|>") in tokens.encoder(path).many(texts)[0]


def test_added_tokens_after_normalising(tmp_path):
    for content in ("<Stop>", "two words"):
        plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        plain.add_tokens([AddedToken(content, normalized=True)])
        path = str(tmp_path / f"{content[:3].strip('<')}.json")
        plain.save(path)
        texts = ["a <STOP> b", "中 <stop>", "Two \n WORDS more", "two words", "stop"]
        for text, ids in zip(texts, tokens.encoder(path).many(texts)):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_simple8b_round_trip():
    random = np.random.default_rng(1)
    for n in (0, 1, 59, 240, 1024, 1025, 5000):
        for high in (1, 2, 300, 1 << 16, 1 << 40, 1 << 63):
            values = random.integers(0, high, n, np.uint64)
            if n > 4:
                values[n // 2] = (1 << 64) - 1
            words, firsts, escapes = token_files.pack_words(values)
            assert (token_files.unpack_words(words, firsts, escapes, n) == values).all()
    small = random.integers(0, 4, 10_000, np.uint64)
    assert len(token_files.pack_words(small)[0]) < 400
    ids, documents = token_files.decode_segment(
        token_files.encode_segment([3, None], [np.array([1, 2]), np.array([7])])
    )
    assert ids == [3, None] and [d.tolist() for d in documents] == [[1, 2], [7]]


def _ids(name, text, end):
    encode = tokens.encoder(public_tokenizers.path(name)).tokenizer.encode
    return np.array(encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files(spark, odd, empty, tmp_path):
    got = registry.queries()["op10_token_files"](spark, SF).orderBy("doc_id").collect()
    start = 0
    docs = _documents(spark).orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for row, doc in zip(got, docs):
        ids = _ids("byte_bpe_50k.json", doc.text, 0)
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for k, table in enumerate((odd, empty)):
        token_files.write_files(table, str(tmp_path / str(k)), public_tokenizers.path("byte_bpe_50k.json"))
        rows = token_files.read_files(spark, str(tmp_path / str(k))).collect()
        assert len(rows) == table.count()
        ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def _check_packed(rows, texts):
    """texts: Counter of (doc_id, text)."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for (doc_id, text), times in texts.items():
        ids = _ids("word_bpe_49k.json", text, 2)
        own = [r for r in by_doc[doc_id] if r.doc_tokens == len(ids)]
        assert sum(r.length for r in own) >= times * len(ids)
        for r in own if len([t for t in texts if t[0] == doc_id]) == 1 else []:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        end = 0
        for offset, length in pieces:
            assert offset == end and length > 0
            end += length
        assert end <= packing.WINDOW and (end == packing.WINDOW or end & (end - 1) == 0)


def test_packing(spark, odd, empty):
    rows = registry.queries()["op4_packing"](spark, SF).collect()
    _check_packed(rows, Counter((r.doc_id, r.text) for r in _documents(spark).collect()))
    _check_packed(packing.pack_documents(odd).collect(), Counter((r[0], r[1]) for r in ODD))
    assert packing.pack_documents(empty).count() == 0


def test_neighbours_are_alike():
    a, b = np.arange(100, 200, dtype=np.uint32), np.arange(300, 400, dtype=np.uint32)
    index = packing.Index([a, b, a[:80], b[:80], np.arange(500, 600, dtype=np.uint32)])
    unused = np.ones(5, bool)
    assert index.neighbours(0, unused)[:2] in ([0, 2], [2, 0])
    unused[[0, 2]] = False
    assert index.neighbours(0, unused) == []


def test_all_ids_of_the_seed_count():
    rare, common = np.arange(24, dtype=np.uint32), np.arange(50, 90, dtype=np.uint32)
    other = np.arange(200, 300, dtype=np.uint32)
    index = packing.Index([np.concatenate((rare, common)), rare, other, common, common[:20], other])
    unused = np.array([False, False, True, True, True, True])
    assert index.neighbours(0, unused) == [3, 4]


def test_windows_take_all_neighbours_first():
    """Brute force over short documents: many more than 33 fill a window."""
    random = np.random.default_rng(5)
    topics = [random.permutation(np.arange(k * 500, k * 500 + 500, dtype=np.uint32)) for k in range(3)]
    docs = [
        (k, np.append(random.choice(topics[k % 3], 30 + k % 40), packing.END_ID).astype(np.uint32), 0)
        for k in range(600)
    ]
    pieces = defaultdict(list)
    packing.Packer(0, lambda doc, start, n, sequence, at: pieces[sequence].append((doc[0], start, n))).shard(docs, True)
    index = packing.Index([d[1][:-1] for d in docs])
    scores = np.zeros((600, 600))
    for seed in range(600):
        for term in index.terms[seed]:
            part = slice(index.starts[term], index.starts[term + 1])
            scores[seed, index.documents[part]] += index.weights[part]
    starts, left = [0] * 600, sum(len(d[1]) for d in docs)
    unused = set(range(600))
    for sequence in sorted(pieces):
        if left < packing.WINDOW:
            break
        seed, filled, want = min(unused), 0, []
        order = sorted(unused - {seed}, key=lambda k: (not scores[seed, k] > 0, -scores[seed, k], k))
        for k in [seed, *order]:
            n = min(len(docs[k][1]) - starts[k], packing.WINDOW - filled)
            want.append((k, starts[k], n))
            starts[k], filled = starts[k] + n, filled + n
            if starts[k] == len(docs[k][1]):
                unused.discard(k)
            if filled == packing.WINDOW:
                break
        assert [w[0] for w in want] == [p[0] for p in pieces[sequence]] and want == pieces[sequence]
        left -= packing.WINDOW
    assert sequence > 3
    empty = [(k, np.array([packing.END_ID], np.uint32), 0) for k in range(packing.WINDOW)]
    pieces.clear()
    packing.Packer(0, lambda doc, start, n, sequence, at: pieces[sequence].append(doc[0])).shard(empty, True)
    assert pieces[0] == list(range(packing.WINDOW))


# language, quality


def test_language(spark, odd, empty):
    rows = registry.queries()["op1_language"](spark, str(TESTDATA / "sf0.01")).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()}
    for held_out in (False, True):
        own = [r for r in rows if r.held_out == held_out]
        assert sum(r.lang_pred == truth[r.doc_id] for r in own) >= 0.98 * len(own)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    learnt = _documents(spark)
    found = {r.doc_id: r for r in language.identify(odd, learnt).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4
    assert found[7].lang_pred != "und" and 0 <= found[7].score <= 1
    assert language.identify(odd, empty).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, learnt).count() == 0


def test_keep_identified_keeps_clashing_columns(spark, odd):
    table = odd.select(
        "*", F.lit("theirs").alias("lang_pred"), F.lit(3).alias("_folded"),
        F.lit("x").alias("Bits_per_byte"), F.lit("y").alias("_score"), F.lit(1).alias("a b"),
    )
    kept = language.keep_identified(table)
    assert kept.columns == table.columns
    want = Counter(tuple(r) for r in table.collect() if any(c.isalpha() for c in r.text or ""))
    assert Counter(map(tuple, kept.collect())) == want
    once = language.identify(table, _documents(spark))
    assert once.columns[-3:] == list(language.PREDICTED) and once.first()["_folded"] == 3


def test_rows_stay_out_of_python(spark):
    learnt = _documents(spark)
    docs = learnt.select("doc_id", "text", F.lit("kept").alias("extra"))
    found = language.identify(docs, learnt)
    for rows in (found, found.filter("lang_pred <> 'und'"), language.keep_identified(learnt)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # workers get folded texts alone, few at a time and once, not batches of whole rows
        assert "InArrow" not in plan and "ArrowEval" not in plan
        assert plan.count("BatchEvalPython") == plan.count("predict(") == 1
    # neither neighbours nor partitions have a part in a prediction
    dealt = language.identify(docs.repartition(7), learnt)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, dealt.collect()))


def test_sample_is_bounded_and_has_every_language(spark):
    rows = [(k, LONG[k:], f"one{k}") for k in range(6)] + [(k, LONG, "many") for k in range(4)]
    rows += [(1, "short one", "copies")] * 30_000 + [(1, "", "none"), (2, "a bc", "small")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chars = len(LONG) // 10
    drawn = defaultdict(list)
    for r in language.sample(labelled, chars).collect():
        drawn[r.lang].append(r)
    assert set(drawn) == {r[2] for r in rows} - {"none"}
    for lang in [f"one{k}" for k in range(6)] + ["many"]:
        assert 0.3 * chars < sum(len(r.text) * r.copies for r in drawn[lang]) < 2 * chars
        assert all(len(r.text) <= language.PIECE_CHARS and r.lead + r.text in LONG for r in drawn[lang])
    assert [(r.text, r.copies) for r in drawn["copies"]] == [("short one", 30_000)]
    # whole texts in pieces are learnt from as whole texts
    counts = Counter()
    windows = language._windows(np.frombuffer(LONG.lower().encode(), np.uint8), np.zeros(1, np.int64), language.ORDER)
    for window in windows.tolist():
        counts[window] += 1
    one = labelled.filter("lang = 'one0'")
    assert {w: n for _, w, n in language.fit(one, len(LONG))} == counts


def test_code_lengths_are_exact(spark):
    model = language.build(language.fit(_documents(spark).filter("lang IS NOT NULL")))
    share = np.exp2(-model.bits.astype(float))
    share[:, 0] *= 256 - (len(np.unique(model.symbols[:256])) - 1)
    assert np.allclose(share.sum(axis=1), 1, atol=1e-5)
    # by hand: one byte seen once has half of the empty context's mass, the escape the rest
    start = 256 << 9 | 256 << 18 | 256 << 27
    small = language.build([("x", start | 97, 1)])
    bits = small.score(np.frombuffer(b"a", np.uint8), np.array([0]))
    assert np.isclose(bits[0, 0], 1)
    bits = small.score(np.frombuffer(b"b", np.uint8), np.array([0]))
    assert np.isclose(bits[0, 0], -np.log2(0.5 / 255))
    # scoring in lots changes nothing
    data, begins = np.frombuffer(b"ab cd" * 400 + b"the end", np.uint8), np.array([0, 700, 701])
    whole = model.score(data, begins)
    lot, language._LOT_BYTES = language._LOT_BYTES, 97
    try:
        assert np.allclose(model.score(data, begins), whole)
    finally:
        language._LOT_BYTES = lot


def test_quality(spark, odd, empty):
    folder = str(TESTDATA / "sf0.01")
    rows = {r.doc_id: r for r in registry.queries()["op2_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    none = empty.select("doc_id", F.lit(1).alias("quality"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    some = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scores = quality.score(odd, some).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(empty, some).count() == 0


def test_isotonic():
    at, value = quality.isotonic(np.array([3.0, 1, 2, 2, 4]), np.array([1, 0, 1, 0, 0]))
    assert (np.diff(value) >= 0).all() and np.interp(1, at, value) == 0
    assert np.isclose(np.interp(4, at, value), 0.5)


# fingerprints


def test_fingerprints(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in _documents(spark).orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in registry.queries()["op3_fingerprints"](spark, SF).collect()}
    seen = {}
    for k, (doc_id, text) in enumerate(docs):
        n, after = len(text), docs[(k + 1) % len(docs)][1]
        edited = text[: n - n // 4] + after[: n // 4]
        row = rows[doc_id]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (row.n_chars, seen.setdefault(text, row.fingerprint)) == (n, row.fingerprint)
        agree = next((i for i, (a, b) in enumerate(zip(text, edited)) if a != b), min(n, len(edited)))
        assert row.common_prefix == agree
    assert len(set(seen.values())) == len(seen)
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.97
    assert fingerprints.compare_with_next(odd).count() == len(ODD)
    assert fingerprints.compare_with_next(empty).count() == 0
    alone = fingerprints.compare_with_next(odd.filter("doc_id = 8")).first()
    assert alone.near_next == 1.0


def test_spans():
    a, b = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in ("xxabcdef", "abcdexxabc"))
    assert fingerprints.same_span(a, 2, b, 0, 5) and not fingerprints.same_span(a, 2, b, 0, 6)
    assert fingerprints.common_extension(a, 0, b, 5) == 5


def test_long_unrelated_texts_are_unlike():
    random = np.random.default_rng(8)
    size = 3_000_000
    make = lambda: fingerprints.Fingerprint(
        fingerprints.Prefixes(random.integers(97, 5000, size).astype(np.uint32))
    )
    a, b = make(), make()
    assert a.likeness(b) < 0.01 and a.likeness(a) == 1
    assert (a.slots < fingerprints._EMPTY).all() and len(str(a).split("-")[2]) == 128 * 10
    none = fingerprints.sketch(fingerprints.Prefixes(fingerprints.code_points("ab")))
    assert (none == fingerprints._EMPTY).sum() >= 125


# dedup


def test_exact_dedup_edges(spark, odd, empty):
    rows = exact_dedup.deduplicate(odd).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    group = {r.doc_id: r for r in rows}
    assert group[6].keep_id == 4 and group[6].group_size == 3  # case differs for 5
    assert {group[k].keep_id for k in (1, 2, 3)} == {3}
    assert exact_dedup.deduplicate(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.text_sha256 for r in rows})


def test_buckets_split_and_chains(spark):
    docs = _documents(spark)
    whole = exact_dedup.deduplicate(docs).select(*exact_dedup.QUERY_COLUMNS[:4])
    split = exact_dedup.deduplicate(docs, bucket_keys=7)
    assert split.filter("depth < 60").agg(F.max("depth")).first()[0] >= 5
    assert split.filter("depth < 60").groupBy("bucket").count().filter("count > 7").count() == 0
    # two copies are more than a quarter of seven
    assert split.filter("depth = 60 AND group_size < 2").count() == 0
    assert whole.exceptAll(split.select(*whole.columns)).count() == 0
    weak = lambda text: F.rpad(F.substring(F.md5(text.cast("binary")), 1, 1), 64, "0")
    for size in (exact_dedup.BUCKET_KEYS, 7):
        chained = exact_dedup.deduplicate(docs, digest=weak, bucket_keys=size)
        assert chained.agg(F.max("chain")).first()[0] > 5
        assert whole.exceptAll(chained.select(*whole.columns)).count() == 0


def test_the_directory_decides(spark, monkeypatch):
    """Were texts sent to wrong buckets, copies would not meet."""
    docs = spark.createDataFrame([(k, f"text {k % 40}") for k in range(200)], "doc_id long, text string")
    right = exact_dedup.deduplicate(docs, bucket_keys=64)
    assert right.filter("kept").count() == 40 and right.agg(F.max("depth")).first()[0] >= 2
    made = exact_dedup.directory
    # a directory without the slots of some buckets
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: made(*a).filter("bucket > 0"))
    assert exact_dedup.deduplicate(docs, bucket_keys=64).filter("kept").count() < 40
    # one that leads a slot to two buckets
    monkeypatch.setattr(
        exact_dedup, "directory",
        lambda *a: made(*a).withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1000))),
    )
    assert exact_dedup.deduplicate(docs, bucket_keys=64).filter("kept").count() == 80


def _components(docs):
    sets, ids = {}, defaultdict(list)
    for doc_id, text in docs:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = WORDS.findall(low)
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
        ids[frozenset(runs)].append(doc_id)
        sets[doc_id, text] = frozenset(runs)
    root = {s: s for s in ids if s}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    every = list(root)
    for k, a in enumerate(every):
        for b in every[:k]:
            common = len(a & b)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for s in every:
        least[find(s)] += ids[s]
    known = {k: min(v, key=lambda d: (d is None, d or 0)) for k, v in least.items()}
    return {key: (len(s), known[find(s)] if s else key[0]) for key, s in sets.items()}


@pytest.mark.parametrize("settings", [{}, {"WIDE": 2, "BLOCK": 3, "FREQUENT": 2, "MEMBERS": 1}])
def test_near_dedup(spark, odd, empty, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(near_dedup, name, value)
    random = np.random.default_rng(3)
    docs = [(5000 + r.doc_id, r.text) for r in _documents(spark).limit(120).collect()]
    base = docs[0][1].split()[:90]
    for k in range(40):  # a family in which some link and some don't
        own = list(base)
        for at in random.integers(0, len(own), int(random.integers(0, 4))):
            own[at] = f"new{k}x{at}"
        docs.append((1000 + k, " ".join(own)))
    docs += [(r[0], r[1]) for r in ODD]
    got = near_dedup.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = _components(docs)
    assert len(got) == len(docs)
    by_id = {k[0]: v for k, v in want.items()}
    assert len({v[1] for v in by_id.values()}) < len(by_id) - 10
    for row in got:
        assert (row.n_shingles, row.component_id) == by_id[row.doc_id], row.doc_id


def test_near_dedup_keeps_one(spark, odd, empty):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, None, 8, 9, 10])
    assert near_dedup.join(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


# mixing


def test_mixing(spark, odd, empty):
    docs = _documents(spark)
    rows = mixing.mix(docs).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert r.taken <= 3 * r.size and r.size == len(WORDS.findall(
            docs.filter(F.col("doc_id") == r.doc_id).first().text)) if r.doc_id < 5 else True
    total = sum(r.size for r in rows)
    assert np.isclose(sum(own[0].target for own in by_source.values()), total)
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert own[0].target <= 3 * own[0].source_size
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    taken = {(r.doc_id, r.source): r.repeats for r in rows if r.repeats}
    out = Counter((r.doc_id, r.source) for r in mixing.repeat_documents(docs).collect())
    assert out == taken
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert mixing.repeat_documents(odd).columns == odd.columns


def test_water_filling(spark):
    words = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 100)], "source string, source_size long")
    target = {r.source: r.target for r in mixing.targets(words).collect()}
    # a and c stop at three times their size, b and the null source share 900 as 2 to 5
    assert target["a"] == 30 and np.isclose(sum(target.values()), 1200)
    assert target["c"] <= 270 and target[None] == 300


# pages


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d}"
    events = spark.createDataFrame(
        [
            ("l", "bad.org", "add", day(5)), ("l", "bad.org", "add", day(6)), ("l", "bad.org", "remove", day(9)),
            ("l", "bad.org", "add", day(20)), ("m", "x.bad.org", "add", day(8)), ("m", "gone.net", "remove", day(1)),
            ("m", "same.net", "add", day(3)), ("m", "same.net", "remove", day(3)), (None, None, "add", None),
        ],
        "list string, pattern string, action string, day string",
    ).withColumn("day", F.to_date("day"))
    captures = spark.createDataFrame(
        [
            (1, "http://bad.org/a", day(4)), (2, "http://www.bad.org", day(5)), (3, "https://u@X.BAD.org:80/", day(8)),
            (4, "http://bad.org", day(9)), (5, "http://bad.org.", day(25)), (6, "http://notbad.org", day(6)),
            (7, None, day(6)), (8, "mailto:x", day(6)), (9, "http://bad.org", None), (10, "http://same.net", day(4)),
        ],
        "id int, url string, fetched_on string",
    ).withColumn("fetched_on", F.to_date("fetched_on"))
    valid = url_lists.intervals(events)
    assert valid.count() == 3
    rows = {r.id: r for r in url_lists.evaluate(captures, valid).collect()}
    assert [k for k in sorted(rows) if rows[k].blocked] == [2, 3, 5]
    assert (rows[3].list, rows[3].pattern, rows[3].active_entries) == ("m", "x.bad.org", 2)
    assert url_lists.evaluate(captures.limit(0), valid).count() == 0
    assert url_lists.evaluate(captures, valid.limit(0)).filter("blocked").count() == 0


def test_warc(spark):
    source = spark.createDataFrame(
        [
            ("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "H: 1\r\n",
             "<html lang=de><title>T &amp; t</title><p>One</p><script>x<y</script><br>two&nbsp;&lt;3"),
            (None, None, None, None, None),
        ],
        "record_id string, target_uri string, warc_date string, headers string, payload string",
    )
    rows = warc.derive(source).collect()
    assert len(rows) == 4
    text = next(r for r in rows if r.record_type == "conversion" and r.refers_to == "<urn:uuid:1>")
    assert text.block == "T & t\nOne\ntwo <3"
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    assert f"Content-Length: {len(text.block.encode())}\r\n" in text.record
    meta = next(r for r in rows if r.record_type == "metadata" and r.refers_to == "<urn:uuid:1>")
    assert "language: de\r\n" in meta.block and meta.block.endswith("H: 1\r\n")
    assert warc.derive(source.limit(0)).count() == 0


# pipeline


def test_pipeline(spark, odd, empty):
    docs = _documents(spark)
    first = {}
    for r in docs.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        if any(c.isalpha() for c in key):
            best = first.get(key)
            if best is None or (-len(r.text), r.doc_id) < (-len(best.text), best.doc_id):
                first[key] = r
    parts = _components([(r.doc_id, r.text) for r in first.values()])
    kept = [r for r in first.values() if parts[r.doc_id, r.text][1] == r.doc_id]
    mixed = mixing.mix(docs.filter(F.col("doc_id").isin([r.doc_id for r in kept])))
    times = {r.doc_id: r.repeats for r in mixed.collect()}
    want = {r.doc_id: times[r.doc_id] * len(_ids("word_bpe_49k.json", r.text, 2)) for r in kept if times[r.doc_id]}
    rows = corpus_pipeline.run(spark, SF).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
