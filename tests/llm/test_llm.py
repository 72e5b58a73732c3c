"""The training-data operators against libraries, brute force and exact round trips, with odd inputs."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from graphquarry.llm import bpe, components, dac, decontam, fmindex, jaccard, langid, merkle, token_count, toxicity, warc

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(80)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [None, "", " ", "a", "  two  spaces\n\n ", "x" * 3000, "naïve café, it's <|endoftext|> 中文 🙂\x85\x1c", "don't\n 's"]
SCHEMA = "doc_id long, text string, n_tokens int, k string, t string"


@pytest.fixture(scope="module")
def docs(spark):
    passage, base = prose(60), prose(120)
    texts = ODD + [prose(rng.randint(1, 200)) for _ in range(40)] + [base, base, base.replace(base.split()[60], "changed", 1), base + " end"]
    texts += [prose(30) + " " + passage + " " + prose(20), passage + " " + prose(40), "z z z " * 40]
    rows = [(i, t, 1, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[-1]], SCHEMA), [(i, t) for i, t, *_ in rows + [rows[-1]]]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs[0], path, P.PATTERN).collect()}
    for i, t in docs[1]:
        ids = ref.encode_ordinary(t or "")
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids and got[i]["decoded"] == (t or "")
    assert bpe.encode_documents(empty(spark), path, P.PATTERN).count() == 0


def test_counts_and_files(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    ids = {i: ref.encode(t or "", add_special_tokens=False).ids for i, t in docs[1]}
    for r in token_count.count_tokens(docs[0], path, P.PATTERN).collect():
        assert r["n_tokens"] == len(ids[r["doc_id"]]) and r["over_limit"] == (r["n_tokens"] > 1024)
    manifest = dac.write_ids(docs[0], path, 2, file_ids=500)
    got = sorted(map(tuple, dac.read_ids(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "ids").collect()))
    at = 0
    for (i, _), r in zip(sorted(docs[1], key=lambda x: x[0]), got):
        want = [*ids[i], 2]
        assert r == (i, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
        at += len(want)
    assert dac.read_ids(dac.write_ids(empty(spark), path, 2)).count() == 0


def test_codes_random_access():
    """Any token by few short reads, as many in a file of a hundred times the size."""
    most = []
    for n in (3000, 300_000):
        ids = np.array([rng.choice([0, 5, 255, 256, 70_000, 2**31]) for _ in range(n)], np.uint32)
        raw, reads = dac.pack(ids, [1], np.array([0])), []
        reader = dac.Reader(lambda at, size, raw=raw, reads=reads: reads.append(size) or raw[at : at + size])
        assert (reader.every() == ids).all()
        most.append(0)
        for at in [0, n - 1, *(rng.randrange(n) for _ in range(500))]:
            reads.clear()
            assert reader.token(at) == ids[at]
            most[-1] = max(most[-1], sum(reads))
    assert most[0] == most[1] < 400


def test_token_files_by_odd_keys(spark):
    path = P.path("byte_bpe_50k.json")
    for kind, rows in (("smallint", [(3, "c"), (None, None), (1, "a"), (1, "a")]), ("string", [("b", "x " * 5000), (None, ""), ("a", "é")])):
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        got = dac.read_ids(dac.write_ids(df, path, 2), kind=kind).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0 if kind == "smallint" else x or ""))
        assert all(r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in got)
        file = dac.write_ids(df, path, 2).orderBy("first_key").first()
        assert dac.tokens_at(file["path"], [0]) == [2]


def test_warc(spark):
    pages = [(1, "http://a.example.com/x", "same"), (2, "https://b.example.com:8080/y?q=1", "same"), (3, None, None), (4, "no url here", ""), (5, "http://a.example.com/x", "é<p>"), (None, "http://z.org", "same")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, key string")
    directory = warc.write_archives(df)
    got = {r["page_id"]: r for r in warc.read_archives(directory).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: r["refers_to"] for i, r in got.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: None, None: 2}
    found = warc.lookup(directory, ["com,example,a)/x", "com,example,c)/", "com,example,b:8080)/y?q=1"]).collect()
    assert sorted((r["key"], r["page_id"]) for r in found) == [("com,example,a)/x", 1), ("com,example,a)/x", 5), ("com,example,b:8080)/y?q=1", 2)]
    assert {r["page_id"]: bytes(r["payload"]) for r in found if r["payload"] is not None} == {2: b"same", 5: "é<p>".encode()}
    assert warc.lookup(directory, []).count() == 0
    assert warc.read_archives(warc.write_archives(df.where("false"))).count() == 0
    large = spark.createDataFrame([(1, "http://x.org", "é" * 3_000_000), (2, "http://x.org", "small"), (3, "http://y.org", "small"), (4, "http://y.org", "é" * 3_000_000)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(large, least=100)).collect()}
    assert got == {1: (6_000_000, 4), 2: (5, None), 3: (5, None), 4: (6_000_000, None)}


def test_decontamination(spark, docs):
    texts = dict(docs[1])
    items = [(1, " ".join(texts[30].split()[:14]).upper() if texts[30] else "q"), (2, "zz"), (3, None), (4, "!!"), (None, "changed")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r["doc_id"]: r for r in decontam.contamination(docs[0], bench).collect()}
    for i, t in docs[1]:
        ws, hit, ids = cut(t), set(), set()
        for item, text in items:
            w = cut(text)
            n = min(10, len(w))
            for a in range(len(w) - n + 1 if n else 0):
                for b in range(len(ws) - n + 1):
                    if ws[b : b + n] == w[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add("null" if item is None else str(item))
        want = (len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
        assert tuple(got[i])[1:] == want
    assert got[30]["contaminated"]
    clean = decontam.decontaminate(docs[0], bench)
    assert clean.columns == docs[0].columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["contaminated"]}
    assert decontam.contamination(empty(spark), bench).count() == 0 and decontam.contamination(docs[0], bench.where("false")).where("contaminated").count() == 0


def test_toxicity(spark):
    def text(bad):
        return prose(40) + (" " + rng.choice(["idiot", "scum", "moron"]) if bad else "") + " " + prose(40)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    machine = toxicity.learn(df, labels, lambda k: k % 5 == 0)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, machine).collect()}
    held = [i for i, *_ in rows if i % 5 == 0]
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.97 and got[900]["score"] == got[901]["score"] < 0.5
    assert 0 <= min(r["score"] for r in got.values()) and max(r["score"] for r in got.values()) <= 1
    nothing = toxicity.learn(df, labels.where("false"), lambda k: k % 5 == 0)
    assert {r["predicted"] for r in toxicity.score_toxicity(df, nothing).collect()} == {0}


def test_pairs_are_learned():
    """An insult counts only beside a group mention."""
    rows, labels = [], []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({10} | {11} * a | {12} * b if False else {10, *([11] * a), *([12] * b)}), np.int64))
        labels.append(float(a and b))
    machine = toxicity.fit(rows, np.array(labels))
    assert machine.score(np.array([10, 11, 12])) > 0.5 > max(machine.score(np.array([10, 11])), machine.score(np.array([10, 12])))


def test_merkle(spark, docs):
    got = merkle.compare_edited(docs[0]).collect()
    order = sorted(((i, t or "") for i, t in docs[1]), reverse=True)
    want = []
    for n, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(n + 1) % len(order)][1]
        new = t[: len(t) - half] + after[:half]
        same = merkle.fingerprint(t)[0] == merkle.fingerprint(new)[0]
        assert same == (t == new)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.fingerprint(t)[0], merkle.fingerprint(new)[0], same))
    assert sorted((*tuple(r)[:5], r["near_edited"] == 1) for r in got) == sorted(want)
    assert all(0 <= r["near_next"] <= 1 for r in got)
    got = {r["doc_id"]: r for r in got}
    prints = [r["fingerprint"] for r in got.values()]
    texts = {i: t or "" for i, t in docs[1]}
    assert len(set(prints)) == len(set(texts.values()))
    a, b = merkle.fingerprint("one.\ntwo.\n\nthree.")[0], merkle.fingerprint("one.\ntwo!\n\nthree.")[0]
    assert merkle.differing(a, b) == [(0, 1)] and merkle.differing(a, a) == []
    text = "\n\n".join(f"head {i}.\nline {i}, more.\nend {i}." for i in range(6))
    at = lambda new: merkle.differing(merkle.fingerprint(text)[0], merkle.fingerprint(new)[0])
    assert at("new one.\nnew two.\n\n" + text) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]  # and the blank line between, a section itself
    assert at(text.replace("line 3", "lane 3")) == [(6, 1)] and at(text.replace("line 3, more.\n", "")) == [(6, 1)]
    assert (0, 0) in at("")
    assert merkle.compare_edited(empty(spark)).count() == 0


def test_language(spark):
    words = {"aa": "the and of ing tion", "bb": "der und die ung heit", "cc": "les des que ment aux"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (903, "Ω" * 50, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.learn(df, lambda k: k % 4 == 2)).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows)
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[903]["rejected"] and got[903]["lang_pred"] in words
    nothing = langid.identify(df, langid.learn(df.where("false"), lambda k: F.lit(False)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


FOREIGN = [
    "La casa è molto bella e il giardino è pieno di fiori colorati che profumano tutta la strada.",
    "Wczoraj poszliśmy do parku, gdzie dzieci bawiły się przy fontannie aż do wieczora.",
    "Bugün hava çok güzel olduğu için arkadaşlarımla birlikte sahilde uzun bir yürüyüş yaptık.",
    "De kinderen spelen buiten in de tuin terwijl hun ouders het eten klaarmaken voor vanavond.",
]


def test_language_samples():
    """What is learned from a text is its counts and those of runs of its words, of bounded size."""
    assert langid.Sample.of("12 !?") is None and langid.Sample.of("") is None
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(100_000))
    for text in ("aé b cc", "Ω" * 70, long):
        s, words = langid.Sample.of(text), langid.WORD.findall(text)
        assert len(s.at) <= (1 + len(langid.LENGTHS)) << langid.BITS
        for place, n in enumerate((len(words), *langid.LENGTHS)):
            got = langid.dense([s], place)[0]
            runs = [" ".join(words[a : a + n]) for a in range(min(len(words) - n + 1, 40))]
            if len(words) > 1000 and place:
                assert got.any()
            else:
                assert any((got == langid.counted([r])[0][0]).all() for r in runs) if runs else not got.any()


def test_language_rejection(spark):
    """Unlearned languages in Latin script go although junk, single words and wrong labels are learned from; clean texts
    of 12 words stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**6 + i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang in ("en", "de", "fr", "es") for t in ("xqzj", "Ω ω", *FOREIGN[:2]))]
    model = langid.learn(docs.union(spark.createDataFrame(odd, docs.schema)), lambda k: k % 4 == 2)
    held = docs.where("doc_id % 4 = 2").collect()
    short = [" ".join(w[:12]) for w in (r["text"].split() for r in held) if len(set(w[:12])) > 8]
    rows = [(i, t, None) for i, t in enumerate([*FOREIGN, *short])]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(spark.createDataFrame(rows, docs.schema), model).collect()}
    assert all(got[i] for i in range(len(FOREIGN)))
    assert len(short) > 100 and sum(got[i] for i in range(len(FOREIGN), len(rows))) <= 0.01 * len(short)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, f"{x * 3} {x * 2} {x}{i}", x * 2) for i, x in enumerate("abcde" * 8)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lambda k: F.lit(False), sample=5)
    assert set(model.languages) == {x * 2 for x in "abcde"}


def brute_windows(texts, window=35):
    where = Counter()
    cut = [(t or "").encode().split() for t in texts]
    for ws in cut:
        where.update(tuple(ws[i : i + window]) for i in range(len(ws) - window + 1))
    out = []
    for ws in cut:
        gone = {j for i in range(len(ws) - window + 1) if where[tuple(ws[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(ws), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(ws) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(fmindex, "HOT", hot)
    got = sorted(map(tuple, fmindex.repeated_words(docs[0]).collect()))
    want = sorted((i, *w) for (i, _), w in zip(docs[1], brute_windows([t for _, t in docs[1]])))
    assert got == want and any(r[2] for r in got)
    assert fmindex.repeated_words(empty(spark)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in fmindex.without_repeats(docs[0]).collect()}
    assert all(kept[i] == t for (i, t), w in zip(docs[1], want) if not w[2])


def test_fm_index_against_brute_force():
    for _ in range(30):
        pieces = [np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 30))]) for _ in range(rng.randint(1, 12))]
        window = rng.randint(2, 8)
        seen = Counter(tuple(p[i : i + window].tolist()) for p in pieces for i in range(len(p) - window + 1))
        want = [[i for i in range(len(p) - window + 1) if seen[tuple(p[i : i + window].tolist())] > 1] for p in pieces]
        assert [x.tolist() for x in fmindex.repeated_windows(fmindex.FMIndex(pieces), pieces, window)] == want


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, size, percent):
    texts = [*ODD, "a b", "A  b", "a b c d", "a b c e"]
    for _ in range(12):
        ws = prose(rng.randint(6, 90)).split()
        for _ in range(6):
            texts.append(" ".join(ws))
            ws[rng.randrange(len(ws))] = rng.choice(WORDS)
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    sizes, roots = brute_components(texts, size, percent)
    got = sorted(map(tuple, jaccard.jaccard_components(df, size=size, percent=percent).collect()))
    assert got == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, roots))]
    kept = {r["doc_id"] for r in jaccard.one_of_each(df, size=size, percent=percent).collect()}
    assert kept == set(roots)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_one_of_each_with_odd_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    near = lambda t: t + " more"
    rows = [(3, a), (None, near(a)), (None, b), (5, near(a)), (5, c), (9, near(c)), (7, d), (7, near(d)), (None, e), (None, near(e)), (None, e), (1, b), (1, b), (None, None), (None, None), (8, " "), (8, " ")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect())
    one = lambda *of: sum(got.pop(x, 0) for x in of) == 1
    assert one((3, a), (None, near(a)), (5, near(a))) and one((7, d), (7, near(d))) and one((None, e), (None, near(e)))
    assert got == {(5, c): 1, (1, b): 1, (None, None): 2, (8, " "): 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 35), (50, 50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "x int, y int")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 35: 30, 40: 30}


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontaminated", "encoded"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() > 0.9 * docs.count()
    assert corpus_pipeline.substrings(spark, docs, folder).columns == docs.columns
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and out.where(F.sha2("decoded", 256) != F.col("decoded_sha256")).count() == 0
