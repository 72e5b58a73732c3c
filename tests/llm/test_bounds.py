"""Ways that small tables don't take: crowded tiles, and sides that are too large to broadcast."""

import random

import pytest
from test_llm import SCHEMA, brute_components

from graphquarry.llm import common, components, decontam, jaccard

rng = random.Random(31)
VOCABULARY = [f"w{i}" for i in range(400)]


def families(groups, copies):
    out = []
    for _ in range(groups):
        ws = [rng.choice(VOCABULARY) for _ in range(rng.randint(30, 60))]
        for _ in range(copies):
            out.append(" ".join(ws))
            for _ in range(rng.randint(0, 2)):
                ws[rng.randrange(len(ws))] = rng.choice(VOCABULARY)
    return out


@pytest.mark.parametrize("crowded", [0, 1])
def test_crowded_tiles(spark, monkeypatch, crowded):
    """With every tile crowded, pairs are found by rare shingles instead: the same components."""
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    texts = families(12, 8)
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    sizes, roots = brute_components(texts, 4, 85)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, roots))]
    assert len(set(roots)) < len(texts)


def test_rare_pairs_of_a_large_group(spark, monkeypatch):
    """Copies of one text with three edits each share their rarest words' shingles, but no two link: their pairs aren't made, and linked ones are made once."""
    monkeypatch.setattr(jaccard, "CROWDED", 0)
    made, whole = [], jaccard.rare_pairs

    def counted(*args):
        out = whole(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "rare_pairs", counted)
    draw, base, texts = random.Random(7), [f"b{i}" for i in range(150)], []
    for i in range(80):
        ws = list(base)
        for at in draw.sample(range(150), 3):
            ws[at] = f"x{i}-{at}"
        texts += [" ".join(ws)] + [" ".join(ws[:-1])] * (i % 10 == 0)
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    sizes, roots = brute_components(texts, 5, 80)
    assert sorted(map(tuple, jaccard.jaccard_components(df, size=5, percent=80).collect())) == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, roots))]
    assert len(set(roots)) < len(texts) and made[0] <= 160, made


def test_windows_by_shuffle(spark, monkeypatch):
    """Decontamination gives the same rows whether the windows are broadcast or shuffled."""
    texts = families(6, 3)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    items = spark.createDataFrame([(i, " ".join(t.split()[5:25])) for i, t in enumerate(texts[::4])] + [(90, None), (91, "w1")], "item_id long, text string")
    small = sorted(map(tuple, decontam.contamination(docs, items).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontam.contamination(docs, items).collect())) == small
    assert any(r[-1] for r in small) and not all(r[-1] for r in small)


def test_components_by_short_plans(spark, monkeypatch):
    """Each step reads what was written before it, so that no query's plan, which the driver holds, grows with the rounds;
    stars are left as they are, without a round."""
    sources, whole = [], components.written

    def counted(df, name):
        sources.append(df._jdf.queryExecution().analyzed().toString().count("Relation"))
        return whole(df, name)

    monkeypatch.setattr(components, "written", counted)
    path = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(60)]
    star = [(b"900", f"{i}".encode()) for i in range(901, 930)] + [(b"999", b"999")]
    for edges in (path + star, star, path[:1], []):
        draw = random.Random(len(edges))
        folder = common.written(spark.createDataFrame(draw.sample(edges, len(edges)), "x binary, y binary"), "test-edges")
        sources.clear()
        got = {bytes(r["node"]): bytes(r["root"]) for r in components.components(folder).collect()}
        ends = sorted({e for pair in edges for e in pair} - {b"999"})
        assert got == {e: b"000" if e < b"900" else b"900" for e in ends}
        assert max(sources) <= 2, sources
        assert len(sources) == 2 or edges == path + star, sources


def test_shingles_of_classes_without_links_are_not_joined(spark, monkeypatch):
    """Texts that share a passage but have as many words of their own link with nothing: they go before their shingles are
    joined with counts, and linked ones stay."""
    monkeypatch.setattr(jaccard, "CROWDED", 0)
    left, whole = [], jaccard.written

    def counted(df, name):
        out = whole(df, name)
        if name == "jaccard-linkable":
            left.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    line, texts = " ".join(f"line{i}" for i in range(60)), families(2, 6)
    texts += [f"{line} " + " ".join(f"own{i}-{j}" for j in range(60)) for i in range(40)]
    texts += [f"{line} {line} end{i}" for i in range(3)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    members = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    base = jaccard.sketched(members, "doc_id", "text", 4, 85)
    classes = base.groupBy("c", "s").agg(jaccard.F.min(jaccard.F.struct("k", "th")).alias("rep"), jaccard.F.first("n").alias("n"))
    crowd = base.select("s", jaccard.F.col("s").alias("label")).distinct()
    pairs = jaccard.rare_pairs(crowd, whole(classes, "test-classes"), members, "doc_id", "text", 4, 85).distinct().count()
    assert pairs >= 3 and 3 <= left[0] <= 15, (pairs, left)
    sizes, roots = brute_components(texts, 4, 85)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, roots))]
