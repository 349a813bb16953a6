"""The text operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apexrank.llm import chat_format, decontamination, kernels, language_id, license_scan, near_dedup, pieces, quality_model, quality_rules, registry, sharding, tokens, warc
from apexrank.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
ODD = [
    (1, None, None, "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t\x0b ", "en", None, 5),
    (4, "a b", "en", "s", 3),
    (5, "A  b", "fr", "s", 4),
    (6, LONG, "en", "s", len(LONG)),
    (7, LONG + " tail", "en", "s", 0),
    (8, "x" * 50_000, "de", "s", 0),
    (9, "12 34 !! ##", None, "s", 0),
    (9, "12 34 !! ##", None, "s", 0),
    (None, "no id at all here", "en", "s", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("letters", F.lit("x"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    ran = con.execute(registry.ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(frame.columns)
    pick = lambda columns, found: sorted(tuple(repr(r[i]) for i in sorted(range(len(columns)), key=lambda i: columns[i])) for r in found)
    assert pick(frame.columns, frame.collect()) == pick(names, ran.fetchall())


# 10: near-duplicates


def shingle_sets(rows, k):
    out = {}
    for i, text in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, k, percent):
    rng = np.random.default_rng(4)
    base = words(docs[0][1])[:150]
    near = []
    for i in range(60):  # a group whose members are linked to some others only
        w = list(base)
        for j in rng.choice(len(w), rng.integers(0, 9), replace=False):
            w[j] = f"edit{rng.integers(0, 40)}"
        near.append((10_000 + i, " ".join(w)))
    rows = docs + near
    sets = shingle_sets(rows, k)
    want = components(sets, percent)
    found = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent).collect()}
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in found.items())


def test_near_duplicates_of_odd_rows(spark, odd, none):
    found = near_dedup.near_duplicates(odd, 3, 85).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(ODD)
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True)
    assert by[5].component_id == 4 and not by[5].kept and by[4].n_shingles == 1
    assert by[7].component_id == 6
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(none).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, b + " end"), (9, c), (7, c), (11, None), (11, "other words of their own"), (5, a)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(5, 5, True)] * 3 + [(7, 5, False)] * 2 + [(9, 5, False)] + [(11, 11, True)] * 2


def test_texts_around_the_threshold_lose_no_link(spark):
    rng = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):  # texts around the threshold, few of them linked to the least
        w = list(base)
        for j in rng.choice(len(w), rng.integers(1, 6), replace=False):
            w[j] = f"edit{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert found == components(shingle_sets(rows, 3), 85)


def test_parities_differ_in_no_more_cells_than_sets_in_elements():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 200, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for changed in (0, 1, n // 3, n):
            b = np.concatenate([a[changed:], rng.integers(0, 2**63, changed).astype(np.uint64)])
            cells = sum(int(x).bit_count() for x in (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64))
            assert cells <= len(set(a.tolist()) ^ set(b.tolist()))


def test_texts_just_below_the_threshold_are_told_by_their_parities(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base, rows, pairs = [f"w{i}" for i in range(120)], [], []
    for i in range(100):  # sets of 118 that differ in about 36, of 19 allowed
        w = list(base)
        for j in rng.choice(len(w), 3, replace=False):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    rare = near_dedup._rare_pairs
    monkeypatch.setattr(near_dedup, "_rare_pairs", lambda *a: pairs.append(rare(*a).distinct()) or pairs[-1])
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert found == components(shingle_sets(rows, 3), 85)
    assert pairs and pairs[0].count() < 300


def test_every_coordinate_of_a_sketch_fills():
    sets = [np.arange(1, n + 1, dtype=np.uint64) for n in (1, 2, 30, 1000)]
    found = near_dedup.sketch(sets, 64)
    assert (found != np.iinfo(np.uint64).max).all()
    a, b = kernels.mix(np.arange(1000, dtype=np.uint64)), kernels.mix(np.arange(100, 1100, dtype=np.uint64))
    same = (near_dedup.sketch([a], 512) == near_dedup.sketch([b], 512)).mean()
    assert abs(same - 900 / 1100) < 0.08


def test_components_of_a_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, j) for j in range(101, 140)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


def test_word_hashes_do_not_depend_on_slabs(monkeypatch):
    texts = pa.array(["alpha beta", None, "", "béta  gamma\n", LONG])
    whole = np.concatenate([h for _, h, _ in kernels.text_words(texts)])
    monkeypatch.setattr(kernels, "SLAB", 100)
    assert (np.concatenate([h for _, h, _ in kernels.text_words(texts)]) == whole).all()
    assert len(whole) == sum(len(words(t)) for t in texts.to_pylist())


# 4: quality rules


def test_quality_counts_equal_brute_force(spark, odd, none):
    found = quality_rules.score_quality(odd).collect()
    assert len(found) == len(ODD)
    for (_, text, *_), r in zip(sorted(ODD, key=lambda x: (x[0] or 0, x[1] or "")), sorted(found, key=lambda r: (r.doc_id or 0, r.n_words)), strict=True):
        w = words(text)
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)), r
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(runs)
        assert r.n_repeat_words == len({i + j for i, t in enumerate(runs) if seen[t] > 1 for j in range(3)})
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.score_quality(none).collect() == []
    assert quality_rules.filter_quality(none).collect() == []


@pytest.mark.parametrize("place", [2, 12, 24, 60])
def test_repeated_words_whatever_the_bits_of_a_place(spark, docs, monkeypatch, place):
    monkeypatch.setattr(quality_rules, "PLACE", place)  # few bits of place or of hash: runs are sorted as pairs
    rng = np.random.default_rng(place)
    rows = [*docs[:60], *[(80_000 + i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(60)], (99_000, LONG)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.n for r in frame.select("doc_id", quality_rules.repeat_words(quality_rules.words(F.col("text"))).alias("n")).collect()}
    for i, text in rows:
        w = words(text)
        runs_ = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        seen = Counter(runs_)
        assert found[i] == len({p + j for p, t in enumerate(runs_) if seen[t] > 1 for j in range(3)}), i


def test_order_of_rules_never_changes_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in quality_rules.score_quality(docs).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.filter_quality(docs).collect()} == want
    rate = [s / c for _, c, s in quality_rules.ordered(docs)]
    assert rate == sorted(rate, reverse=True)


# 9: chats


def test_chats_read_back(spark):
    tricky = "[INST] <~ [~ </s> [/INST][OUT] \\E é "
    rows = [(1, 0, "user", tricky, "x"), (1, 1, "assistant", tricky * 2, "x"), (2, 0, "[ROLE]odd[/ROLE]", None, "x"), (2, 0, None, "t", "x"), (3, 1, "assistant", "", "x"), (3, 0, "user", "q", "x"), (4, 0, "assistant", "first", "x")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, valid string"))
    found = {r.conv_id: r for r in chat_format.digest_chats(chats).collect()}
    for i in (1, 2, 3, 4):
        own = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == i)
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert found[i].n_turns == len(own)
        assert found[i].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert found[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and found[i].loss_chars == len(loss)
    assert [found[i].valid for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")).collect() == []


def test_odd_chats(spark):
    rows = [(None, 0, "user", "a", 1, "x"), (None, 1, "assistant", LONG, 1, "x"), (5, 0, "user", "q", 1, "x"), (5, 0, "user", "q", 1, "x"), (6, None, "user", None, 1, "x")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, segments int, formatted string"))
    found = {r.conv_id: r for r in chat_format.digest_chats(chats).collect()}
    assert set(found) == {None, 5, 6}
    assert found[None].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and found[None].valid
    assert found[5].n_turns == 2 and not found[5].valid and found[6].loss_chars == 0


# 6: shards


def test_shards_are_even_and_gapless(spark, odd, none):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    found = sharding.assign_shards(many).collect()
    size, slots = Counter(), {}
    for r in found:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(found) == 3000 and sorted(size) == list(range(16))
    assert max(size.values()) - min(size.values()) <= 4 * (51 + sharding.OVERFULL * sum(size.values()) / (16 * sharding.SHARD_RANGES))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == len(ODD) and all(r.text_crc32 == zlib.crc32((t or "").encode()) for r in rows for i, t, *_ in ODD if i == r.doc_id and i != 9)
    assert sharding.assign_shards(none).collect() == []


def test_shards_follow_the_order_of_keys(spark, docs):
    copies = [(50_000 + i, "a text that many rows hold, again and again") for i in range(700)] + [(60_000 + i, f"twin {i // 2}") for i in range(200)] + [(60_000, "twin 0")]
    frame = spark.createDataFrame([*docs, *copies], "doc_id bigint, text string").withColumns({"k2": F.lit("clash"), "size": F.lit(1), "r": F.lit("x")})
    text = {i: t for i, t in [*docs, *copies]}
    digest = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    found = sharding.assign_shards(frame, 4).collect()
    row = lambda r: (zlib.crc32(text[r.doc_id].encode()), digest[r.doc_id], r.doc_id)
    assert [row(r) for r in sorted(found, key=lambda r: (r.shard, r.slot))] == sorted(map(row, found))
    total, sizes, of = sum(r.size for r in found), Counter(), {}
    for r in found:
        sizes[r.shard] += r.size
        of.setdefault(text[r.doc_id], []).append(r)
    most = max(r.size for r in found)
    share = sharding.OVERFULL * total / (4 * sharding.SHARD_RANGES) + most
    assert all(abs(sizes[s] - total / 4) <= 2 * share for s in range(4))
    assert all(len({r.shard for r in rows}) == 1 for rows in of.values() if sum(r.size for r in rows) <= share)


# 5: WARC


def test_archives_round_trip(spark):
    page = "<p>" + "same page " * 30 + "</p>"
    rows = [(3, "u3", page), (1, "u1", page), (2, "line\r\nbreak %", None), (5, None, "short"), (6, "u", "short"), (7, "u", ""), (None, "u", page), (8, "b", "big " * 500_000)]
    rows += [(100 + i, f"http://e/{i}", f"<html>{i} {'abc ' * i}</html>") for i in range(60)]
    found = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))).collect()}
    assert len(found) == len(rows)
    for i, url, html in rows:
        data = (html or "").encode()
        r = found[i]
        again = i == 3
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None)
        assert r.url == (url or "") and (r.payload is None if again else bytes(r.payload) == data)
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_archive_with_faults_is_refused():
    import io

    import zstandard

    good = warc.record(1, "u", hashlib.sha256(b"body").hexdigest(), "response", None, b"body", 4)
    sample = [f"<html>{i} common text of pages {i * i}</html>".encode() * 4 for i in range(200)]
    own = warc.train_dictionary(sample)
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own))
    whole = warc.archive_head(own) + press.compress(good) + press.compress(good)
    assert own and [r["block"] for r in warc.read_archive(io.BytesIO(whole))] == [b"body", b"body"]
    for bad in (good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Type: response\r\n", b""), good[:-1]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(zstandard.ZstdCompressor().compress(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(whole[:-3])))


def test_faults_come_back_as_rows(spark, tmp_path):
    import zstandard

    press = zstandard.ZstdCompressor()
    good = warc.record(1, "u", hashlib.sha256(b"body").hexdigest(), "response", None, b"body", 4)
    again = warc.record(2, "u", hashlib.sha256(b"body").hexdigest(), "revisit", 1, b"body", 4)
    bad = [good.replace(b"body", b"bodx"), good.replace(b"Target-URI: u", b"Target-URI: \xff"), again.replace(b"X-Payload-Length: 4\r\n", b"")]
    whole = b"".join(press.compress(x) for x in [good, *bad, again])
    (tmp_path / "a.warc.zst").write_bytes(whole)
    (tmp_path / "b.warc.zst").write_bytes(press.compress(good) + b"no frame at all")
    names = spark.createDataFrame([("a.warc.zst",), ("b.warc.zst",), ("a.warc.zst",)], "name string")
    found = warc.read_archives(spark, f"file://{tmp_path}", names, faults=True).collect()
    assert sorted(r.page_id for r in found if r.fault is None) == [1, 1, 2]
    assert sorted(r.fault.split(":")[0] for r in found if r.fault) == ["a frame is damaged", "a revisit does not tell its payload's length", "headers are not UTF-8", "payload digest does not match the block"]
    with pytest.raises(Exception, match="WarcError"):
        warc.read_archives(spark, f"file://{tmp_path}", names).collect()
    assert warc.read_archives(spark, f"file://{tmp_path}", names.limit(0)).collect() == []


def test_the_drawn_payloads_are_few_and_the_same(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("page "), F.col("id")).alias("html"))
    first, second = (warc.draw_payloads(p, 50) for p in (pages, pages.repartition(7)))
    assert len(first) == 50 and first == second


# 1: tokens


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)


def test_tokens_equal_the_library(spark, docs, library, odd, none):
    rows = docs + [(90_001, LONG), (90_002, "no" * 3000 + " \n▁é中 \U0001f600"), (90_003, None), (90_004, " ")]
    found = {r.doc_id: r for r in tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=512).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        assert found[i].ids == library.encode(text or ""), i
        assert found[i].round_trip
    back = {r.doc_id: r.text for r in tokens.decode(spark.createDataFrame([(i, r.ids) for i, r in found.items()], "doc_id bigint, ids array<int>")).collect()}
    assert all(back[i] == (text or "").replace("▁", " ") for i, text in rows)
    assert tokens.encode(odd).count() == len(ODD) and tokens.encode(none).collect() == []


def test_tokens_of_many_groups_of_chunks(spark, library, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 3)
    rows = [(1, LONG), (2, "no" * 4000), (3, "é中.,\n  x" * 900), (4, "a " * 1025)]
    found = {r.doc_id: r for r in tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=256).collect()}
    for i, text in rows:
        assert found[i].ids == library.encode(text) and found[i].round_trip, i


def test_few_words_are_remembered():
    v = pieces.Vocabulary.parse(tokens.load_model())
    coded = lambda i: "▁" + "".join(chr(97 + i // 26**n % 26) for n in range(4))
    first = v.word_ids(coded(0))
    for i in range(310_000):
        v.word_ids(coded(i))
    assert coded(0) not in v.known and coded(0) not in v.older and len(v.known) + len(v.older) <= 300_000
    assert v.word_ids(coded(0)) == first


def test_words_part_where_no_piece_lies_across(library):
    v = pieces.Vocabulary.parse(tokens.load_model())
    rng = np.random.default_rng(5)
    marks = list("ab etnE é中½²_-'’.,;:!?()[]/0189#%\n\t▁") + ["e.g", "Inc.", ".com", " the", "tion"]
    for _ in range(3000):
        text = "".join(rng.choice(marks, rng.integers(1, 40)))
        assert np.frombuffer(v.encode(v.normal(text)), "<i4").tolist() == library.encode(text), text


def best_unigram(scores, text):
    best = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            own = scores.get(text[begin:end], -20.0 if end - begin == 1 else None)
            if own is not None:
                best[end] = max(best[end], best[begin] + own)
    return best[-1]


def test_unigram_scan_finds_the_best_path():
    rng = np.random.default_rng(2)
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -4.5, "aba": -6.0, "bb": -5.0, "aab": -7.0, "▁a": -3.2, "▁": -2.0}
    v = pieces.Vocabulary(["<unk>", *scores], [0.0, *scores.values()], [pieces.UNKNOWN] + [pieces.NORMAL] * len(scores), pieces.UNIGRAM, True)
    v.floor = -20.0
    for _ in range(60):
        text = v.normal("".join(rng.choice(list("ab c"), rng.integers(12, 60))))
        cuts = list(range(0, len(text) - 6, 6))
        ends = [*cuts[1:], len(text)]
        states = tokens.scan([{(s, t): w for s, t, w in v.transfer(text, b, e, b == 0)} for b, e in zip(cuts, ends, strict=True)])
        path = [p for b, e, s, t in zip(cuts, ends, states[:-1], states[1:], strict=True) for p in v.trace(text, b, e, s, t)]
        assert "".join(path) == text
        assert abs(sum(scores.get(p, -20.0) for p in path) - best_unigram(scores, text)) < 1e-9


def test_transfer_products_are_associative():
    a, b, c = ({(i, j): float((i * 7 + j * 3 + s) % 5) for i in range(4) for j in range(4) if (i + j + s) % 3} for s in range(3))
    assert pieces.compose(pieces.compose(a, b), c) == pieces.compose(a, pieces.compose(b, c))


# 2 and 7: classifiers


def test_languages_of_held_out_documents(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    found = language_id.predict_languages(spark.read.parquet(f"{sf}/documents.parquet"))
    held = found.where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    by = {r.doc_id: r for r in language_id.predict_languages(odd).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[9].lang_pred == "und" and by[6].lang_pred != "und"
    assert language_id.predict_languages(none).collect() == []
    assert language_id.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def brute_grams(text):
    data = text.encode()
    low = bytearray(data.lower() if data.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    for i in range(1, len(low)):
        if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E:
            low[i] = data[i] + 32
    counts = np.zeros(language_id.WIDTH)
    for n, buckets, base in ((2, language_id.PAIRS, 0), (3, language_id.TRIPLES, language_id.PAIRS)):
        for i in range(len(low) - n + 1):
            code = int.from_bytes(low[i : i + n], "little")
            counts[base + ((code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - buckets.bit_length() + 1))] += 1
    return np.sqrt(counts) / max(np.sqrt(counts.sum()), 1e-9)


def test_language_features_and_decoding_equal_brute_force():
    texts = ["Élan Ñandú ÜBER", "a", "", "plain words, twice: plain words"]
    found = np.concatenate([x for _, x in language_id.features(pa.array(texts))])
    assert np.allclose(found, [brute_grams(t) for t in texts], atol=1e-6)
    rng = np.random.default_rng(1)
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, rng.normal(size=(5, 7)), rng.normal(size=7), rng.random((4, 7)) + 0.5, 9.0)
    x = rng.normal(size=(50, 5))
    best, share, unsure = model.predict(x)
    for i, row in enumerate(x):
        margin = [sum(row[f] * model.weights[f, j] for f in range(5)) + model.bias[j] for j in range(7)]
        loss = [sum(model.trust[c, j] * np.log1p(np.exp(-margin[j] * code[c, j])) for j in range(7)) for c in range(4)]
        near = sorted(loss)
        assert best[i] == loss.index(near[0]) and abs(share[i] - np.exp(-near[0]) / sum(np.exp(-v) for v in loss)) < 1e-9
        assert unsure[i] == (near[1] - near[0] < language_id.GAP or near[0] > 9.0)


def test_a_rare_language_is_learned(spark, docs):
    rows = [(i, t, "en") for i, t in docs if t] * 20 + [(90_000 + i, " ".join(["zorg", "quux", "xyzzy", "frobni"][(i + j) % 4] for j in range(30)), "zz") for i in range(14)]
    assert language_id.quotas({"en": 5000, "zz": 14, "fr": 900}, 1200) == {"zz": 14, "fr": 593, "en": 593}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(frame)
    assert model.langs == ["en", "zz"]
    got = language_id.identify(spark.createDataFrame([(1, "xyzzy quux zorg frobni " * 9)], "doc_id bigint, text string"), model).first()
    assert got.lang_pred == "zz" and not got.ambiguous


def test_the_language_stage_drops_what_the_model_doubts(spark, docs):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd_ones = [(70_001, "0x9f 7b3c! " * 20, None), (70_002, None, None), (70_003, "Ж щ ю э " * 30, None), (70_004, "!!! ??? 123", "en")]
    rows = base.unionByName(spark.createDataFrame(odd_ones, "doc_id bigint, text string, lang string"))
    left = {r.doc_id for r in language_id.filter_language(rows).collect()}
    said = {r.doc_id: r for r in language_id.predict_languages(rows).collect()}
    assert left == {i for i, r in said.items() if r.lang_pred != "und" and not r.ambiguous}
    assert not left & {70_002, 70_003, 70_004} and said[70_003].ambiguous
    assert len(left & {r.doc_id for r in base.collect()}) >= 0.97 * base.count()


def test_few_labels_among_many_rows_are_all_used(spark, monkeypatch):
    rows = [(i, f"text number {i} of many", ("en", "fr")[i % 2] if i % 100 < 2 else None) for i in range(4000)]
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda x, langs: seen.append(Counter(langs)))
    language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert seen == [Counter(en=40, fr=40)]


def test_stages_keep_clashing_columns(spark, odd, tmp_path):
    items = spark.createDataFrame([(1, "no such words in any text")], "item_id bigint, text string")
    clash = odd.withColumns({"lang_pred": F.lit("mine"), "leak_doc": F.lit(5), "shard": F.lit(9), "slot": F.lit("s")})
    for frame in (language_id.filter_language(clash), decontamination.decontaminate(clash, items), quality_rules.filter_quality(clash)):
        assert frame.columns == clash.columns
        assert all((r.lang_pred, r.score, r.letters, r.leak_doc) == ("mine", "clash", "x", 5) for r in frame.collect())
    unique = clash.where("doc_id <> 9")
    sharding.write_shards(unique, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text) for r in back.collect() if r.text) == sorted((r.doc_id, r.text) for r in unique.collect() if r.text)
    assert {r.slot for r in back.collect()} == {"s"}


def test_long_texts_count_as_short_ones(monkeypatch):
    text = pa.array([LONG[:3000]])
    want = next(language_id.features(text))[1]
    monkeypatch.setattr(language_id, "SLAB", 101)
    assert np.allclose(next(language_id.features(text))[1], want)


@pytest.mark.parametrize("classes", [1, 2, 4, 5, 9, 30])
def test_codewords_differ(classes):
    code = language_id.codewords(classes)
    assert len({tuple(c) for c in code}) == classes


def test_quality_of_held_out_documents(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_model.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = found.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    order = np.argsort(np.argsort(good + bad))
    auc = (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    assert auc > 0.9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)
    few = spark.createDataFrame([(4, 1), (6, 0), (7, None), (None, 1)], "doc_id bigint, quality int")
    assert quality_model.score_documents(odd, few).count() == len(ODD)
    assert {r.score for r in quality_model.score_documents(odd, few.limit(0)).collect()} == {0.5}
    assert quality_model.score_documents(none, few).collect() == []


def brute_score(model, text):
    wrap = (1 << 64) - 1
    mixed = lambda x: int(kernels.mix(np.array([x & wrap], np.uint64))[0])
    data, base = text.encode(), int(kernels.BASE)
    hashes = [mixed(sum((b + 1) * pow(base, j, 1 << 64) for j, b in enumerate(w.encode()))) for w in words(text)]
    codes = [(h, 1) for h in hashes] + [(h * base + g, 2) for h, g in zip(hashes, hashes[1:])]
    codes += [(int.from_bytes(data[i : i + n], "little"), n) for n in quality_model.GRAMS for i in range(len(data) - n + 1)]
    cells = [mixed(c + kind * 0x9E3779B97F4A7C15) % quality_model.BUCKETS for c, kind in codes]
    mean = sum(model.vectors[c] for c in cells) / max(1, len(cells)) + np.zeros(quality_model.WIDTH)
    z = np.exp(mean @ model.output + model.bias)
    return z[1] / z.sum()


def test_quality_scores_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    model = quality_model.Model(rng.normal(size=(quality_model.BUCKETS, quality_model.WIDTH)), rng.normal(size=(quality_model.WIDTH, 2)), rng.normal(size=2))
    texts = ["two words", "", None, "é", "a longer text, with Some Words and some words again\n" * 5]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found = next(quality_model._scored(model)([batch()])).column("score").to_pylist()
    assert np.allclose(found, [brute_score(model, t or "") for t in texts])
    monkeypatch.setattr(kernels, "SLAB", 64)  # the last text now is a long one
    assert np.allclose(next(quality_model._scored(model)([batch()])).column("score").to_pylist(), found)


# 8 and 3: windows


def sets_of_similarity(rng, n, common):
    shared = rng.integers(1, 1 << 62, common)
    return [[int(x) for x in (*shared, *rng.integers(1, 1 << 62, n - common))] for _ in range(2)]


def test_recall_of_bands_and_of_fingerprints(spark):
    """Windows at the threshold (containment 0.8 of 50 shingles: similarity 2/3; weighted similarity 0.8: 40 of 45 in common)."""
    rng = np.random.default_rng(6)
    pairs = [sets_of_similarity(rng, 50, 40) for _ in range(400)]
    frame = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    keys = frame.select(F.arrays_overlap(license_scan.band_keys(F.col("a")), license_scan.band_keys(F.col("b"))).alias("met"))
    assert keys.where("met").count() == len(pairs)
    near = spark.createDataFrame([sets_of_similarity(rng, 45, 40) for _ in range(400)], "a array<bigint>, b array<bigint>")
    prints = near.select(decontamination.simhash(F.col("a")).alias("a"), decontamination.simhash(F.col("b")).alias("b"))
    found = prints.select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"), F.arrays_overlap(decontamination.blocks(F.col("a")), decontamination.blocks(F.col("b"))).alias("met")).collect()
    assert all(r.d <= decontamination.RADIUS for r in found) and all(r.met for r in found)
    assert 6 < np.mean([r.d for r in found]) < 13


def test_leaks_of_documents_with_clashing_columns(spark):
    items = spark.createDataFrame([(1, "five plain words and more of them"), (1, "five plain words and more of them")], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "x " * 9 + "five plain words and more of them", 1, "a", 2), (1, "clean", 1, "b", 2), (2, LONG + " five plain words and more of them", 1, "c", 2)], "doc_id bigint, text string, item_id int, key string, print int")
    assert sorted((r.doc_id, r.item_id, r.start_word) for r in decontamination.contaminated(rows, items).collect()) == [(1, 1, 9), (2, 1, 60_000)]
    left = decontamination.decontaminate(rows, items)
    assert left.columns == rows.columns and [r.key for r in left.collect()] == ["b"]


def plain(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def runs(tokens_, k=5):
    k = min(k, len(tokens_))
    return [tuple(tokens_[i : i + k]) for i in range(len(tokens_) - k + 1)]


def brute_leaks(rows, items):
    out = set()
    for i, text in rows:
        w = plain(text)
        for item, t in items:
            own = plain(t)
            if not own:
                continue
            k, ref = min(5, len(own)), Counter(runs(own))
            for s in range(max(1, len(w) - len(own) + 1)):
                win = Counter(tuple(w[s : s + len(own)][j : j + k]) for j in range(max(0, min(len(own), len(w) - s) - k + 1)))
                both = sum((ref & win).values())
                if both and both >= 0.8 * sum((ref | win).values()):
                    out.add((i, item))
                    break
    return out


def test_leaks_equal_brute_force(spark, docs, odd, none):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall() + [(900, "Three short words"), (901, None), (902, " .. "), (903, "again " * 12)]
    rows = [*docs, (7001, "said three SHORT, words!"), (7002, "again " * 40), (7003, None), (7004, "filler words " * 20 + items[0][1].upper().replace(" ", "  ") + " more")]
    edited = items[1][1].split()
    edited[len(edited) // 2] = "changed"
    rows.append((7005, "start " + " ".join(edited) + " end"))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), frame).collect()}
    assert found == brute_leaks(rows, items)
    assert {(7001, 900), (7002, 903), (7004, items[0][0])} <= found
    assert decontamination.contaminated(none, frame).collect() == []
    assert decontamination.contaminated(odd, frame.limit(0)).collect() == []
    left = decontamination.decontaminate(spark.createDataFrame([(None, "said three short words", "a"), (None, "clean", "b")], "doc_id bigint, text string, key string"), frame)
    assert [r.text for r in left.collect()] == ["clean"]


def test_leaks_do_not_depend_on_the_filter(spark, docs, monkeypatch):
    from apexrank.llm import windows

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sorted(map(tuple, decontamination.contaminated(frame, items).collect()))
    monkeypatch.setattr(windows, "INLINE", 3)
    for bits in (64, 4096):  # full, and with many wrong hits
        monkeypatch.setattr(windows, "LEAST_BITS", bits)
        monkeypatch.setattr(windows, "MOST_BITS", bits)
        assert sorted(map(tuple, decontamination.contaminated(frame, items).collect())) == want
    held = spark.range(5000).select(F.xxhash64("id").alias("h"))
    monkeypatch.undo()
    monkeypatch.setattr(windows, "INLINE", 3)
    test = windows.known(held)
    assert held.where(test(F.col("h"))).count() == 5000
    assert spark.range(5000, 105_000).select(F.xxhash64("id").alias("h")).where(test(F.col("h"))).count() < 50


def edited(n, ends, inserted):
    """n distinct words, and a copy of them with `ends` words changed at each end and `inserted` words put in the middle."""
    own = [f"w{i}" for i in range(n)]
    copy = [f"a{i}" for i in range(ends)] + own[ends : n // 2] + [f"b{i}" for i in range(inserted)] + own[n // 2 : n - ends] + [f"c{i}" for i in range(ends)]
    return " ".join(own), " ".join(copy)


def most_common(text, ref, distinct):
    """(words of the reference, most shingles in common in any window as long as it)"""
    w, own = plain(text), plain(ref)
    of = (lambda t: Counter(set(runs(t)))) if distinct else (lambda t: Counter(runs(t)))
    return max(sum((of(own) & of(w[s : s + len(own)])).values()) for s in range(max(1, len(w) - len(own) + 1)))


@pytest.mark.parametrize("around", ["", "before it some words stand and after it others"])
def test_leaks_with_insertions_and_changed_ends(spark, around):
    pairs = [edited(60, 1, 2), edited(200, 6, 12), edited(60, 2, 0), edited(60, 8, 8)]
    items = spark.createDataFrame([(i, own) for i, (own, _) in enumerate(pairs)], "item_id bigint, text string")
    rows = [(i, f"{around} {copy} {around}") for i, (_, copy) in enumerate(pairs)]
    want = {}
    for i, text in rows:
        for item, (own, _) in enumerate(pairs):
            c, size = most_common(text, own, False), len(plain(own)) - 4
            if c >= 0.8 * (2 * size - c):
                want[i, item] = c / (2 * size - c)
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert found == want and {(0, 0), (1, 1), (2, 2)} <= set(found) and (3, 3) not in found


def test_licenses_equal_brute_force(spark, docs, odd, none):
    rows = [*docs, (7001, "x " * 30 + "RELEASED under the mit license. " + "y " * 9), (7002, license_scan.TEMPLATES[2][1].replace("copies", "copie")), (7003, "Released under the GPL license"), (7004, None)]
    want = set()
    for i, text in rows:
        w = plain(text)
        for name, t in license_scan.TEMPLATES:
            own = plain(t)
            ref = set(runs(own))
            if any(len(ref & set(runs(w[s : s + len(own)]))) >= 0.8 * len(ref) for s in range(max(1, len(w) - len(own) + 1))):
                want.add((i, name))
    found = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == want and {(7001, "MIT-notice"), (7002, "MIT")} <= found
    assert license_scan.scan_licenses(none).collect() == [] and license_scan.scan_licenses(odd).collect() == []


def test_leaks_of_repeated_shingles(spark):
    pairs = [("x " * 49 + "y " * 59, "x " * 59 + "y " * 49), ("p " * 44 + "q " * 64, "p " * 54 + "q " * 54), ("yes no " * 20 + "a b c d", "yes no " * 20 + "e f g h")]
    items = [(i, own) for i, (own, _) in enumerate(pairs)]
    rows = [(i, copy) for i, (_, copy) in enumerate(pairs)]
    frames = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(*frames).collect()}
    assert found == brute_leaks(rows, items) == {(0, 0), (1, 1), (2, 2)}


@pytest.mark.parametrize("around", ["", "before it some words stand and after it others"])
def test_licenses_with_insertions_and_changed_ends(spark, around):
    pairs = [edited(53, 2, 4), edited(36, 1, 2), edited(40, 4, 0), edited(40, 9, 6)]
    known = spark.createDataFrame([(str(i), own) for i, (own, _) in enumerate(pairs)], "license string, text string")
    rows = [(i, f"{around} {copy} {around}") for i, (_, copy) in enumerate(pairs)]
    shares = {(i, str(j)): most_common(text, own, True) / (len(plain(own)) - 4) for i, text in rows for j, (own, _) in enumerate(pairs)}
    found = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), known).collect()}
    assert found == {at: share for at, share in shares.items() if share >= 0.8}
    assert {(0, "0"), (1, "1")} <= set(found) and (3, "3") not in found


# The pipeline


def test_pipeline_equals_its_parts(spark, library):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: rows[r.doc_id] for r in quality_rules.score_quality(docs).where("kept").collect()}
    kept = docs.where(F.col("doc_id").isin(list(rows)))
    clear = {r.doc_id for r in language_id.predict_languages(kept).where("lang_pred <> 'und' and not ambiguous").collect()}
    rows = {i: t for i, t in rows.items() if i in clear}
    low = components(shingle_sets(rows.items(), 5), 80)
    rows = {i: t for i, t in rows.items() if low[i] == i}
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    leaks = {i for i, _ in brute_leaks(rows.items(), items)}
    want = {i: library.encode(t) for i, t in rows.items() if i not in leaks}
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert found == want


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "odd/benchmark.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns({"doc_id": F.col("doc_id") + 1000, "score": F.lit("own"), "key": F.lit(2), "letters": F.lit("y")})
    base.unionByName(odd).write.parquet(str(tmp_path / "odd/documents.parquet"))
    none.write.parquet(str(tmp_path / "none/documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert found and all(r.round_trip for r in found) and not {r.doc_id for r in found} & {1, 2, 3, 4, 5, 8, 9}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_each_stage_begins_with_collected_heaps(spark):
    import corpus_pipeline

    def collections() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = collections()
        stage(spark, docs, SF)
        assert collections() > before, name


def test_workers_let_their_last_batch_go(monkeypatch):
    batch = {"doc_id": pa.array([1], pa.int64()), "letters": pa.array([True])}
    held, base = [], 0
    monkeypatch.setattr(kernels, "release", lambda: held.append(pa.total_allocated_bytes() - base))
    model = tokens.load_model()
    list(tokens._encode_short(model)(iter([])))  # the vocabulary is loaded
    runs = [near_dedup._signatures(5, 2, 2), near_dedup._sets(5), language_id._scored(None, "letters", ("letters", "text"), ("l", "s", "a")), tokens._encode_short(model)]
    for run in runs:
        held.clear()
        base = pa.total_allocated_bytes()
        for _ in run(pa.RecordBatch.from_pydict(batch | {"text": pa.array(["one two three " * n])}) for n in (10, 200_000)):
            pass
        del _
        assert max(held) < 2_000_000
