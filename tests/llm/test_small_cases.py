"""Null, empty, tied, repeated and empty-table cases of every operator, and brute-force versions on small data."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from framesift.llm import bpe, group_topn, leaks, neighbors, residue, runs, subtitles, term_freq, text_form


# --- one form of text


def forms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["form"] for r in sorted(text_form.with_consistent_text(df, "text", "form").collect(), key=lambda r: r["i"])]


def test_forms_agree_and_differ(spark):
    got = forms(spark, ["Ｐâｔｉｓｓｅｒｉｅ", "Pâtisserie", "Pâtis​serie", "Patisserie", "pâtisserie", None, "", "​﻿", "a b", "a b", "ab", "Вокзал", "5²", "52", "１２", "ệ", "ệ", "ệ", "한글", "한글"])
    assert got[0] == got[1] == got[2] == "Pâtisserie"
    assert len({got[0], got[3], got[4]}) == 3
    assert got[5] is None and got[6] == "" and got[7] == ""
    assert got[8] == got[9] != got[10]
    assert got[12] != got[13] and got[14] == "12"
    assert got[15] == got[16] == got[17] == "ệ"
    assert got[18] == got[19] == "한글"


def test_forms_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = "aeAB ̛̣́̂оＡé­　ồ\U0001f600ợ"
    texts = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(300)})
    got = forms(spark, texts)
    for t, f in zip(texts, got, strict=True):
        apart = unicodedata.normalize("NFD", "".join(map(text_form.map_char, t)))
        assert unicodedata.normalize("NFD", f) == apart, (t, f)


def test_very_long_text(spark):
    assert forms(spark, ["Ａé" * 20000])[0] == "Aé" * 20000


def test_same_reading(spark):
    k = "id string, video_id string, timestamp double, ocr_text string, llm_caption string, text string"
    frames = spark.createDataFrame([("a", "v", 1.0, "ΕХIT", "x", "t"), ("a", "v", 1.0, "ΕХIT", "x", "t"), ("b", "v", 2.0, "EXIT", None, "t"), ("c", "v", None, "ΕXIT", "", "t"), (None, "v", 1.0, "ΕXIT", "", "t"), ("d", "w", 1.0, "ΕXIT", "", "t")], k)
    labels = spark.createDataFrame([(1, "EXIT", "v", [0.0, 2.0]), (1, "EXIT", "v", [0.0, 2.0]), (2, "EXIT", "v", [3.0, 1.0]), (3, None, "v", [0.0, 2.0]), (4, "EXIT", "v", None), (5, "exit", "v", [0.0, 9.0])], "label_id long, query string, video_id string, time_window array<double>")
    assert [tuple(r) for r in text_form.find_same_reading(frames, labels).collect()] == [(1, "a", "ocr_text")]
    assert text_form.find_same_reading(frames.limit(0), labels.limit(0)).collect() == []


def test_same_reading_of_any_window(spark):
    """Windows of all lengths, at borders of stretches, before 0 and without end, against all pairs."""
    rng = random.Random(9)
    inf, nan = float("inf"), float("nan")
    frames = [(f"f{i}", rng.choice("vw"), rng.choice([None, nan, -4.0, 0.0, 7.9999, 8.0, 16.0, rng.uniform(-50, 5e3)]), rng.choice(["AB", "ΑB", "АВ", "x"]), rng.choice([None, "", "ＡＢ"])) for i in range(250)]
    labels = []
    for i in range(150):
        lo = rng.choice([0.0, 8.0, -4.0, rng.uniform(-60, 5e3)])
        labels.append((i, rng.choice(["AB", "ΑΒ"]), rng.choice("vw"), [lo, rng.choice([lo + 0.5, lo + 8, lo + rng.uniform(0, 3000), lo - 1, 1e12, inf, nan])]))
    k = spark.createDataFrame(frames, "id string, video_id string, timestamp double, ocr_text string, llm_caption string")
    q = spark.createDataFrame(labels, "label_id long, query string, video_id string, time_window array<double>")
    got = sorted(map(tuple, text_form.find_same_reading(k, q).collect()))
    alike = {"AB", "ΑB", "АВ", "ＡＢ", "ΑΒ"}
    want = sorted((n, i, f) for n, t, v, (lo, hi) in labels for i, w, ts, *xs in frames for f, x in zip(("ocr_text", "llm_caption"), xs, strict=True) if v == w and ts is not None and lo <= ts < hi and x in alike and x != t)
    assert got == want


# --- similar vectors


def brute_pairs(rows, k, least):
    rows = sorted({i: v for i, v in rows}.items())
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(rows)):
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-s[i, j], rows[j][0]))[:k]
        out |= {tuple(sorted((rows[i][0], rows[j][0]))) for j in order if s[i, j] >= least}
    return out


def test_similar_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 8))
    rows = [(f"k{i:04d}", (base[i % 40] + 0.05 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(f"z{i:03d}", rows[0][1]) for i in range(20)]  # a group of copies
    odd = [("n1", None), ("n2", [0.0] * 8), ("n3", [float("nan")] * 8), ("n4", [1.0]), (None, rows[0][1]), ("n5", [1.0] * 7 + [None])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd + rows[:5]], "id string, vec array<float>, id_a string")
    want = brute_pairs(rows, 5, 0.9)
    assert {(r.id_a, r.id_b) for r in neighbors.similar_pairs(df, "id", "vec", 5, 0.9, scan=None, dim=8).collect()} == want
    got = {(r.id_a, r.id_b) for r in neighbors.similar_pairs(df, "id", "vec", 5, 0.9, scan=100, cells=4, dim=8).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    copies = {p for p in want if p[0][0] == "z" or p[1][0] == "z"}
    assert len(copies & got) >= 0.95 * len(copies)
    assert neighbors.similar_pairs(df.limit(0), "id", "vec").collect() == []


def test_similar_pairs_of_a_dense_cell_over_files(spark, monkeypatch):
    """A cell of most vectors goes over files and batches, and pairs of them meet all the same."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones(8) + 0.01 * rng.standard_normal((300, 8)), rng.standard_normal((80, 8))]).astype(np.float32)
    rows = [(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, vec array<float>")
    for files in (neighbors.FILE, 32):
        monkeypatch.setattr(neighbors, "FILE", files)
        assert {(r.id_a, r.id_b) for r in neighbors.similar_pairs(df, "id", "vec", 3, scan=None).collect()} == brute_pairs(rows, 3, -2)


def test_local_lists_are_opened_once(spark, monkeypatch, tmp_path):
    """Lists that lie far apart are met again and again; however little may be kept, no file is read a second time."""
    import pyarrow as pa

    x, files = np.arange(400, dtype=np.float32).reshape(100, 4), []
    for lo in range(0, 100, 25):
        t = pa.table({"vec": pa.FixedSizeListArray.from_arrays(pa.array(x[lo : lo + 25].ravel()), 4), "ids": [[str(i)] for i in range(lo, lo + 25)]})
        files.append(f"file://{tmp_path}/{lo}.arrow")
        with pa.OSFile(files[-1][7:], "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t, max_chunksize=10)
    monkeypatch.setattr(neighbors, "BATCH", 10)
    opened, fs = Counter(), neighbors.shared_fs
    monkeypatch.setattr(neighbors, "shared_fs", lambda uri: opened.update([uri]) or fs(uri))
    lists = neighbors.Lists(files, np.arange(0, 100, 25), 4, mb=0)
    for _ in range(3):
        for lo, hi in ((0, 12), (90, 100), (20, 60)):
            assert (lists.vectors(lo, hi) == x[lo:hi]).all()
    assert lists.ids(np.array([99, 3, 30, 3])) == {i: [str(i)] for i in (3, 30, 99)}
    assert set(opened.values()) == {1} and len(opened) == 4


@pytest.mark.parametrize(("shape", "full"), [((40, 30), 0.9), ((40, 30), 0.05), ((300, 280), 0.02), ((2, 3), 0.8)])
def test_lists_met_are_those_of_the_heap(shape, full):
    """Of many queries at once, where lists are dense or few, as one heap a query meets them."""
    rng = np.random.default_rng(8)
    counts = (rng.integers(1, 60, shape) * (rng.random(shape) < full)).astype(np.int32)
    d1, d2 = rng.random((25, shape[0])), rng.random((25, shape[1])) ** 2
    for enough, least in ((1, 1), (300, 5), (10**9 if shape[0] < 300 else 9000, 1)):
        want = {i * shape[1] + j for o1, a1, o2, a2 in zip(*neighbors.ascending(d1), *neighbors.ascending(d2), strict=True) for i, j in neighbors.traverse(o1.tolist(), a1.tolist(), o2.tolist(), a2.tolist(), counts, enough, least)}
        assert neighbors.traverse_all(*neighbors.ascending(d1), *neighbors.ascending(d2), counts, enough, least, 16).tolist() == sorted(want)


def test_similar_pairs_size_by_different_vectors(spark, monkeypatch):
    """Copies under other ids don't make more centroids: cells would be empty, and traversals long."""
    rng = np.random.default_rng(6)
    rows = [(f"k{i:03d}", rng.standard_normal(8).astype(np.float32).tolist()) for i in range(100)]
    copies = [(f"{i}/{c}", v) for i, v in rows for c in range(40)]
    sizes, kmeans = [], neighbors.kmeans
    monkeypatch.setattr(neighbors, "kmeans", lambda x, k: sizes.append(k) or kmeans(x, k))
    df = spark.createDataFrame(copies, "id string, vec array<float>")
    assert {(r.id_a, r.id_b) for r in neighbors.similar_pairs(df, "id", "vec", 3, 0.9, scan=None, cell=4).collect()} == brute_pairs(copies, 3, 0.9)
    assert set(sizes) == {5}


# --- frequencies


def test_terms(spark):
    rows = [("1", ["Dog", "Dog", None, ""], "Hi, HI (a)"), ("2", None, None), ("3", [], ""), ("4", ["dog"], "a b hi...")]
    df = spark.createDataFrame(rows, "id string, objects array<string>, text string")
    got = {(r.field, r.term): (r.occurrences, r.records) for r in term_freq.term_counts(df, {"objects": term_freq.list_terms, "text": term_freq.text_terms}).collect()}
    assert got == {("objects", "Dog"): (2, 1), ("objects", "dog"): (1, 1), ("objects", None): (0, 3), ("text", "hi"): (3, 2), ("text", "a"): (1, 1), ("text", "a b"): (1, 1), ("text", None): (0, 3)}
    marks = {(r.field, r.term): r.mark for r in term_freq.mark_terms(term_freq.term_counts(df, {"text": term_freq.text_terms}), common=0.5).collect()}
    assert marks == {("text", "hi"): "common", ("text", "a"): "rare", ("text", "a b"): "rare"}
    assert term_freq.term_counts(df.limit(0), {"text": term_freq.text_terms}).collect() == []


def test_radix_counter_spills(tmp_path):
    import pyarrow as pa

    c = term_freq.RadixCounter(f"file://{tmp_path}/r", rows=200, bits=2)
    want = Counter()
    rng = random.Random(0)
    for _ in range(40):
        terms = [f"t{rng.randint(0, 3000)}" for _ in range(100)]
        want.update(terms)
        h = [hash(t) for t in terms]
        c.add(pa.RecordBatch.from_arrays([pa.array(["f"] * 100), pa.array(terms), pa.array(h, pa.int64()), pa.array([1] * 100), pa.array([1] * 100)], schema=term_freq.SCHEMA))
    assert c.files  # it did spill
    got = Counter()
    for t in c.finish():
        for r in t.to_pylist():
            assert r["term"] not in got
            got[r["term"]] = r["occurrences"]
    assert got == want
    assert not any(p.is_file() for p in tmp_path.rglob("*"))


def test_terms_of_partitions_that_spill(spark):
    """With a few rows held at most, parts are spilled and split on both sides of the shuffle; the counts stay."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["hot", f"w{rng.randint(0, 900)}", f"v{rng.randint(0, 9)}"]) for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r.term: (r.occurrences, r.records) for r in term_freq.term_counts(df, {"text": term_freq.text_terms}, held=150, bits=1).where("term is not null").collect()}
    assert got == {w: (n, sum(w in t.split() for t in texts)) for w, n in Counter(w for t in texts for w in t.split()).items()}


# --- top N


@pytest.mark.parametrize("batch", [3, 10000])
def test_top_n(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([0.5, 0.7, 0.9, None, float("nan")]), i, "x") for i in range(500)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, "g string, s double, i long, rank string").repartition(5)
    got = sorted((r.g, r.i) for r in group_topn.top_n(df, "g", "s", "i", 4).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = defaultdict(set)
    for g, s, i, _ in rows:
        if g is not None and s is not None and s == s:
            best[g].add((-s, i))
    assert got == sorted((g, i) for g, xs in best.items() for _, i in sorted(xs)[:4])
    assert group_topn.top_n(df.limit(0), "g", "s", "i", 4).collect() == []


# --- runs


def brute_runs(rows):
    rows = sorted({i: (v, t, i, s) for v, t, i, s in rows if v is not None and t is not None and i is not None}.values(), key=lambda r: (r[0], r[1], r[2]))
    out = []
    for v, t, i, s in rows:
        s = s if s and None not in s else None
        last = out[-1] if out else None
        if last and last["v"] == v and s and last["s"] and all(abs(x - y) <= 0.1 + 1e-9 for x, y in zip(s, last["s"], strict=True)):
            last |= {"last": i, "n": last["n"] + 1, "t1": t, "s": s}
        else:
            out.append({"v": v, "first": i, "last": i, "n": 1, "t0": t, "t1": t, "s": s})
    return sorted((r["v"], r["first"], r["last"], r["n"]) for r in out)


@pytest.mark.parametrize("chunks", [1, 3, 17])
def test_runs(spark, chunks):
    rng = random.Random(chunks)
    rows, cluster = [], 0.0
    for n in range(400):
        if rng.random() < 0.1:
            cluster += rng.choice([0.05, 5])
        span = None if rng.random() < 0.05 else (cluster + rng.random() * 0.02, None if rng.random() < 0.02 else cluster + 3.0)
        rows.append((rng.choice(["v", "v", "v", "w", None]) if n > 200 else "v", rng.choice([None, float(n // 2), float(n // 2)]), f"i{rng.randint(0, 10**6)}", span))
    rows += rows[:30]
    df = spark.createDataFrame([(*r, "x") for r in rows], "video_id string, timestamp double, id string, cluster_span struct<t_start:double,t_end:double>, seq string")
    got = runs.collapse(df, "video_id", "id", "timestamp", "cluster_span", chunks=chunks)
    assert sorted((r.video_id, r.first_id, r.last_id, r.n) for r in got.collect()) == brute_runs(rows)
    assert runs.collapse(df.limit(0), "video_id", "id", "timestamp", "cluster_span").collect() == []


@pytest.mark.parametrize(("chunks", "fan"), [(1, 2), (2, 2), (5, 2), (20, 3), (37, 2), (61, 64)])
def test_runs_of_one_span_broken_within_chunks(spark, chunks, fan):
    rows = [("v", float(n), f"i{n:04d}", None if n % 7 == 3 else (1.0, 9.0)) for n in range(120)]
    rows += [("w", float(n), f"j{n:04d}", (1.0, 9.0)) for n in range(150)]  # a run over many chunks
    df = spark.createDataFrame(rows, "video_id string, timestamp double, id string, cluster_span struct<t_start:double,t_end:double>")
    got = runs.collapse(df, "video_id", "id", "timestamp", "cluster_span", chunks=chunks, fan=fan)
    assert sorted((r.video_id, r.first_id, r.last_id, r.n) for r in got.collect()) == brute_runs(rows)


def test_first_and_last_run_of_a_chunk_do_not_join(spark):
    span = (1.0, 4.0)
    rows = [("v", float(n), i, s) for n, (i, s) in enumerate([("a", span), ("b", span), ("n", None), ("c", span), ("d", span)])]
    df = spark.createDataFrame(rows, "video_id string, timestamp double, id string, cluster_span struct<t_start:double,t_end:double>")
    for chunks in (1, 2, 5):
        got = runs.collapse(df, "video_id", "id", "timestamp", "cluster_span", chunks=chunks)
        assert sorted((r.first_id, r.last_id, r.n) for r in got.collect()) == [("a", "b", 2), ("c", "d", 2), ("n", "n", 1)]


@given(st.lists(st.tuples(st.sampled_from("vw"), st.sampled_from([None, 1.0, 1.05, 1.2, 5.0])), max_size=40), st.lists(st.integers(0, 40), max_size=8), st.integers(2, 4))
def test_merging_summaries_is_associative(events, cuts, fan):
    """Runs of a sequence cut anywhere, empty chunks included, merged in a tree of any width."""
    events = sorted(events, key=lambda e: e[0])
    one = [runs_row(k, v, x) for k, (v, x) in enumerate(events)]
    edges = sorted({0, len(one), *(c for c in cuts if c < len(one))})
    got, level = [], []
    for chunk, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        summary: list = []
        for r in one[lo:hi]:
            summary, between = runs.merge(summary, [r], 0.1) if summary else ([r], [])
            got += between
        level.append((2 * chunk, summary))  # numbers left out stand for empty chunks
    while len(level) > 1 or level and level[0][0] > 0:
        groups: dict = {}
        for chunk, summary in level:
            into = groups.setdefault(chunk // fan, [])
            groups[chunk // fan], between = runs.merge(into, summary, 0.1) if into else (summary, [])
            got += between
        level = list(groups.items())
    got += [r for _, s in level for r in s]
    want: list = []
    for r in one:
        joined = want and runs.combine(want[-1], r, 0.1)
        want = [*want[:-1], joined] if joined else [*want, r]
    assert sorted((r["first_id"], r["last_id"], r["n"]) for r in got) == [(r["first_id"], r["last_id"], r["n"]) for r in want]


def runs_row(k, v, x):
    x = float("nan") if x is None else x
    return {"seq": v, "first_id": f"{k:03d}", "last_id": f"{k:03d}", "first_t": float(k), "last_t": float(k), "n": 1, "a0": x, "a1": x, "z0": x, "z1": x}


# --- tokens


def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_bpe_matches_and_round_trips():
    e, ref = bpe.Encoder(bpe.read_ranks()), reference_tokenizer()
    rng = random.Random(4)
    texts = ["a" * 5000, "ab" * 3000, "<|endoftext|>", "it's 'S  \n\n x", "\x1cabc \x1d\n", "5²½ 　 １", "00:00:01,643 --> 00:00:06,014\r\n\r\n2"]
    texts += ["".join(rng.choice("ab \n\t\x1cé́힣\U0001f600  's1²") for _ in range(40)) for _ in range(500)]
    for t in texts:
        ids = e.encode(t).tolist()
        assert ids == ref.encode(t, add_special_tokens=False).ids, t
        assert e.decode(ids) == t


def test_bpe_documents(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()]
    assert sorted(got) == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])])
    assert bpe.encode_documents(df.limit(0)).collect() == []


# --- leaks

ITEM = "Nobody opened the orchard from Tivedenomur since the year 1980 and then Lokikokomur painted the old piano twice near the harbour"


def srt(lines):
    return "\n\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},500\n{x}" for i, x in enumerate(lines, 1))


def test_leaks(spark):
    w = ITEM.split()
    quote = w[2:15]
    broken = [" ".join(quote[:4]), "[DOOR SLAMS] " + " ".join(quote[4:8]).upper(), "{\\an8}<i>" + " ".join(quote[8:]).replace("o", "0", 1) + "</i>"]
    shuffled = list(w)
    random.Random(1).shuffle(shuffled)
    docs = [(1, srt(["Yes, of course.", *broken, "No."])), (2, srt([" ".join(w[2:12])])), (3, srt([" ".join(shuffled)])), (4, None), (5, ""), (6, "no cues " + ITEM), (7, srt(["Short one here from Zabanal twice"])), (1, srt(broken)), (8, srt([ITEM.encode().decode("cp1252")]))]
    items = [(10, ITEM), (11, None), (12, "  "), (13, "Short one here from Zabanal twice")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    got = sorted(map(tuple, leaks.leaks(d, spark.createDataFrame(items, "item_id long, passage string")).collect()))
    assert got == [(1, 10), (6, 10), (7, 13), (8, 10)]
    assert leaks.leaks(d.limit(0), spark.createDataFrame(items, "item_id long, passage string")).collect() == []
    assert leaks.leaks(d, spark.createDataFrame([], "item_id long, passage string")).collect() == []


def test_leak_whose_rarest_word_is_damaged(spark):
    words = "the boat was late so we all walked home along that marigold".split()
    assert subtitles.fold("marigqld") not in leaks.Vocabulary(words).ids
    docs = [(1, words[::-1]), (2, words[::-1]), (3, words[-2::-1]), (4, [*words[:-1], "marigqld"])]  # the rarest word by a little
    d = spark.createDataFrame([(i, srt([" ".join(ws)])) for i, ws in docs], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(words))], "item_id long, passage string")
    assert [tuple(r) for r in leaks.leaks(d, items).collect()] == [(4, 10)]


@pytest.mark.parametrize("unread", [1, 2])
def test_leaks_of_twelve_words_some_unread(spark, unread):
    rng = random.Random(unread)
    word = lambda: "".join(rng.choice("bdgkmptz") + rng.choice("aeu") for _ in range(5))
    items = [[word() for _ in range(12)] for _ in range(40)]
    ids = leaks.Vocabulary([w for ws in items for w in ws]).ids
    docs = []
    for n, ws in enumerate(items):
        ws = list(ws)
        for k in rng.sample(range(12), unread):
            ws[k] = ws[k][:4] + "q" + ws[k][5:]
            assert subtitles.fold(ws[k]) not in ids
        docs += [(n, srt([" ".join(ws)])), (100 + n, srt([" ".join(reversed(items[n]))]))]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(ws)) for n, ws in enumerate(items)], "item_id long, passage string"))
    assert sorted(map(tuple, got.collect())) == [(n, n) for n in range(40)]


def test_weighted_shingles():
    item = "a1a b2b c3c d4d e5e f6f g7g h8h".split()
    doc = ["x", *item[:6], "q", "h8h"]
    same = lambda weight, w, doc=doc: leaks.shingle_similarity(doc, item, weight, 1, 0, w)
    assert same([1] * 8, 6) == 1.0  # a1a to f6f
    assert same([1] * 8, 8) == 0.5  # two of four shingles
    assert same([1, 1, 1, 1, 1, 1, 9, 1], 8) == 10 / (5 + 5 + 13 + 13)
    assert leaks.shingle_similarity(doc[:5], item, [1] * 8, 1, 0, 6) == 0.0  # no window of six words
    assert same([1] * 8, 3) == 1.0


def test_leak_in_a_very_long_document(spark, monkeypatch):
    """Slices of a document meet windows across their borders; a long styling or sound description is left out whole."""
    monkeypatch.setattr(leaks, "SLICE", 50)
    rng = random.Random(5)
    fill = lambda n: [rng.choice(["yes", "no", "look", "wait", "here"]) for _ in range(n)]
    docs = [(n, " ".join([*fill(n), *ITEM.split()[:13], *fill(200)])) for n in range(30, 60)]
    docs.append((1, srt([" ".join(ITEM.split()[:6]) + f" [{'DOOR ' * 60}] <font {'x' * 300}>" + " ".join(ITEM.split()[6:13])])))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, ITEM)], "item_id long, passage string"))
    assert sorted(map(tuple, got.collect())) == [(1, 10), *((n, 10) for n in range(30, 60))]


def test_multi_index_meets_all_within_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(300)], np.uint64)
    i, j = leaks.Index(a, np.arange(300), np.zeros(300, int)).near(a ^ flips)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(300) for y in range(300) if bin(int((a[x] ^ flips[x]) ^ a[y])).count("1") <= leaks.RADIUS}


def test_repair():
    t = "¡Está aquí! Người đàn ông “quoted” ♪"
    once = t.encode().decode("cp1252", errors="strict") if False else "".join(dict((v, k) for k, v in subtitles.CP1252.items()).get(c, c) for c in t.encode().decode("latin-1"))
    assert subtitles.repair(once) == t
    assert subtitles.repair(t) == t


# --- residue


def test_trusted_records_are_looked_for_in_all_rows(spark, monkeypatch):
    rows = [(i, "{{ title }}" if i % 120 == 7 else srt(["We left the tram.", "Yes, of course."])) for i in range(600)]
    got = []
    monkeypatch.setattr(residue, "learn", lambda sure, others: got.append((sure, others)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    residue.fit(df, "doc_id", "text", trusted=5, sample=100)
    (sure, others), = got
    assert sure == ["{{ title }}"] * 5 and 60 <= len(others) <= 140
    residue.fit(df, "doc_id", "text", trusted=4, sample=10_000)  # at most so many, by hash
    assert 0 < len(got[1][0]) <= 4 and len(got[1][1]) == 600


def test_residue_filler_of_no_fixed_form(spark):
    rng = random.Random(8)
    noun = ["tram", "piano", "kettle", "bridge", "lamp", "ferry", "orchard"]
    talk = lambda: f"We left the {rng.choice(noun)} behind the {rng.choice(noun)}."
    rows, want = [], set()
    for i in range(300):
        if i % 20 == 3:
            rows.append((i, srt([f"Caption pending {n}" for n in range(9)])))  # one line throughout
            want.add(i)
        elif i % 20 == 7:
            rows.append((i, srt(["Caption pending 3", "Caption pending 8", talk()])))
            want.add(i)
        else:
            rows.append((i, srt(["[DOOR SLAMS]", talk(), "Caption pending 1" if i % 20 == 9 else talk(), "Yes, of course.", talk()])))
    got = {r.doc_id for r in residue.residue_records(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_residue_held_out(spark):
    rng = random.Random(6)
    say = ["We left the {} behind the {}.", "Did you see the {}, {}?", "Look at the {}, it is grey.", "Yes, of course.", "They painted the {} twice."]
    noun = ["tram", "piano", "kettle", "bridge", "lamp", "ferry", "orchard"]
    talk = lambda: rng.choice(say).format(rng.choice(noun), rng.choice(noun))
    bad = ["{{{{ {} }}}}", "<%= {} %>", "${{{}}}"]
    rows, want = [], set()
    for i in range(400):
        if i % 10 == 0:
            kind = i % 40
            lines = [rng.choice(bad).format(rng.choice(["title", "line", "speaker"])) for _ in range(8)] if kind else ["404 Not Found. The page could not be found."]
            text = "404 Not Found\nThe page could not be found." if not kind else srt(lines)
            want.add(i)
        else:
            text = srt([talk() for _ in range(12)] + (["{{ title }}"] if i % 7 == 0 else []))
        rows.append((i, text, "x"))
    half = srt(["{{ a }}", "<%= line %>", talk(), "{{ b }}", "{{ speaker }}"])
    rows += [(1000, half, "x"), (1001, None, "x"), (1002, "", "x"), (1003, " \n ", "x"), (None, "404 Not Found", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, passages string")
    got = {r.doc_id for r in residue.residue_records(df).collect()}
    assert got == want | {1000}
    assert residue.residue_records(df.limit(0)).collect() == []
