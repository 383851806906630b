import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlens.llm import hashing, jaccard_join, line_windows, mixing, pu_quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- hashing -----------------------------------------------------------------------------------------------------

def test_word_hashes(monkeypatch):
    texts = ["Ab cd\n x", None, "", "x  ", "é ü " * 50, " ab"]
    hashes, offsets = hashing.word_hashes(texts)
    assert np.diff(offsets).tolist() == [len(WORD.findall(t or "")) for t in texts]
    words = [w for t in texts for w in WORD.findall(t or "")]
    by_word = defaultdict(set)
    for w, h in zip(words, hashes.tolist(), strict=True):
        by_word[w.lower()].add(tuple(h))
    assert all(len(s) == 1 for s in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    monkeypatch.setattr(hashing, "PART", 3)
    again = hashing.word_hashes(texts)
    assert (again[0] == hashes).all() and (again[1] == offsets).all()


# ---- n-gram Jaccard join -------------------------------------------------------------------------------------------

def shingles(text):
    words = WORD.findall(text or "")
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_join(rows):
    """(doc_id, class_id, copy_id, copies, n_links) with ids that are all different."""
    sets = {i: shingles(t) for i, t in rows}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s if s else i].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    heads = sorted((min(v), k) for k, v in classes.items())
    for (a, s), (b, t) in itertools.combinations([h for h in heads if not isinstance(h[1], int)], 2):
        shared = len(s & t)
        if shared >= 0.8 * (len(s) + len(t) - shared) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((i, find(min(v)), min(v), len(v), links[min(v)]) for v in classes.values() for i in v)


def near_copies(seed=11):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (1, 1, 2, 3, 8, 60):
        base = [word() for _ in range(draw.randint(40, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = word()
            rows.append(" ".join(words))
    shared = " ".join(word() for _ in range(25))
    rows += [shared + " " + " ".join(word() for _ in range(60)) for _ in range(40)]
    rows += rows[3:9] + [None, "", " ", "one two", "one two", "a b c d e"]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [2048, 6])
def test_join_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.join_documents(docs, small=small, recall=0.9999999).select("doc_id", "class_id", "copy_id", "copies", "n_links")
    assert sorted(map(tuple, got.collect())) == brute_join(rows)


def test_join_edges(spark, edge, nothing):
    got = jaccard_join.join_documents(edge).collect()
    assert len(got) == edge.count()
    assert sorted(r["copies"] for r in got if r["doc_id"] == 1) == [1, 2, 2]
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert jaccard_join.join_documents(nothing).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.99999, 0.8, 4) <= 20 and jaccard_join.runs_for(0.9, 0.8, 1) == 2


def pairs_alike(n, seed=5):
    """Min-hashes of ``n`` pairs of sets whose similarity is 0.8: eight tokens shared, one of its own each."""
    tokens = np.random.default_rng(seed).integers(0, 1 << 63, (n, 10), np.uint64)
    return [jaccard_join.min_hashes(list(tokens[:, columns])) for columns in ([*range(8), 8], [*range(8), 9])]


def test_links_of_an_oversized_bucket_reach_the_recall():
    n = 100_000
    one, two = pairs_alike(n)
    met = np.zeros(n, bool)
    for run in range(jaccard_join.runs_for(jaccard_join.RECALL, jaccard_join.LIKE, jaccard_join.LEVELS)):
        pair, node = np.arange(n), np.full(n, hashing.mixed(np.array([run + 1], np.uint64))[0])
        first = np.full(n, run % jaccard_join.HASHES)
        for _ in range(jaccard_join.LEVELS):
            rows, mine = jaccard_join.children(node, one[pair], jaccard_join.LIKE, first)
            _, other = jaccard_join.children(node, two[pair], jaccard_join.LIKE, first)
            pair, node, first = pair[rows][mine == other], mine[mine == other], None
        met[pair] = True
    assert n - met.sum() <= 4  # one is expected


def test_leaves_of_an_oversized_bucket_reach_the_recall(spark):
    n = 4000
    sigs = [(f"{side}{k}".encode(), 9, row.tobytes()) for side, side_sigs in zip("ab", pairs_alike(n), strict=True) for k, row in enumerate(side_sigs)]
    classes = spark.createDataFrame(sigs, "key binary, n long, sig binary")
    found = jaccard_join.leaves(classes, recall=0.99, small=1).select("leaf", F.col("key").cast("string").alias("key"))
    met = found.groupBy("leaf", F.substring("key", 2, 9).alias("pair")).agg(F.count(F.lit(1)).alias("sides")).where("sides = 2")
    assert n - met.select("pair").distinct().count() <= 0.01 * n


def test_recall_out_of_reach_is_refused():
    with pytest.raises(ValueError):
        jaccard_join.runs_for(1.0, 0.8, 4)


def test_chains_have_one_class(spark):
    edges = spark.createDataFrame([(bytes([k + 1]), bytes([k])) for k in range(40)] + [(b"x", b"x"), (b"z", b"y")], "key binary, root binary")
    labels = {bytes(r["key"]): bytes(r["label"]) for r in jaccard_join.connected(edges).collect()}
    assert {labels[bytes([k])] for k in range(41)} == {bytes([0])} and labels[b"z"] == labels[b"y"] == b"y"


# ---- mixing --------------------------------------------------------------------------------------------------------

def test_targets_stop_at_twice_the_size():
    sizes = [100, 1000, 10, 500]
    targets = mixing.fill(sizes, [5, 2, 1, 5], 1.5 * sum(sizes), 2)
    assert math.isclose(sum(targets), 1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(targets, sizes, strict=True))
    open_ = [t / w for t, s, w in zip(targets, sizes, [5, 2, 1, 5], strict=True) if t < 2 * s - 1e-9]
    assert np.allclose(open_, open_[0])
    assert mixing.fill([], [], 0, 2) == [] and mixing.fill([0, 0], [5, 2], 0, 2) == [0.0, 0.0]


def test_split_is_exact():
    quota = np.array([1000, 3, 0, 77])
    parts = mixing.split(quota, 13, 5)
    assert (parts.sum(1) == quota).all() and (parts >= 0).all()
    assert parts.sum(0).max() - parts.sum(0).min() <= 4
    assert (parts == mixing.split(quota, 13, 5)).all()


@pytest.mark.parametrize("blocks", [1, 2, 7, 1000])
def test_permutation(blocks):
    places = mixing.permute(np.arange(blocks), np.full(blocks, blocks), np.full(blocks, 99, np.uint64))
    assert sorted(places.tolist()) == list(range(blocks))
    assert blocks < 100 or places.tolist() != list(range(blocks))


@pytest.mark.parametrize("whole", [False, True])
def test_mix(spark, whole):
    draw = random.Random(12)
    rows = [(k, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(0, 60))), draw.choice(["a", "b", "c", "d", None])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, whole=whole, shards=8).collect()
    sizes = {k: len(WORD.findall(t)) for k, t, _ in rows}
    names = ["a", "b", "c", "d", None]
    total = {n: sum(sizes[k] for k, _, s in rows if s == n) for n in names}
    wanted = dict(zip(names, mixing.fill([total[n] for n in names], [5, 2, 1, 5, 2], 1.5 * sum(total.values()), 2), strict=True))
    taken = defaultdict(int)
    for r in out:
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], total[r["source"]]) and math.isclose(r["target"], wanted[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["end"] - s["begin"] for s in r["spans"])
        for epoch in (0, 1):  # a pass takes no word twice
            spans = sorted((s["begin"], s["end"]) for s in r["spans"] if s["epoch"] == epoch)
            assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        taken[r["source"]] += r["taken"]
    for n in names:
        assert abs(taken[n] - wanted[n]) <= (0.12 if whole else 0.01) * wanted[n] + 5
    again = mixing.mix(docs.repartition(7), whole=whole, shards=8).collect()
    assert {r["doc_id"]: (r["taken"], r["spans"]) for r in again} == {r["doc_id"]: (r["taken"], r["spans"]) for r in out}


def test_mix_edges(edge, nothing):
    out = mixing.mix(edge)
    assert out.count() == edge.count() and out.columns.count("size") == 1 and "text" not in out.columns
    assert out.where("size = 0 AND taken > 0").count() == 0
    assert mixing.mix(nothing).count() == 0
    shards = mixing.dealt_out(mixing.mix(edge, whole=True, shards=3))
    assert shards.count() == out.sparkSession.createDataFrame([(0,)]).count() * mixing.mix(edge, whole=True, shards=3).select(
        F.sum(F.size("spans"))).first()[0]


# ---- classifiers ---------------------------------------------------------------------------------------------------

def labelled_texts(count, seed, marker):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(400)]
    out = []
    for k in range(count):
        text = [draw.choice(words) for _ in range(draw.randint(15, 60))]
        bad = k % 4 == 0
        out.append((" ".join(marker(draw, text) if bad else text) + " the of and", int(bad)))
    return out


def insult(draw, text):
    text[draw.randrange(len(text))] = draw.choice(["moronic", "moronity", "scumbag", "Idiot,"])
    return text


def test_toxicity_finds_words_it_was_taught(spark):
    rows = [(k, t, y) for k, (t, y) in enumerate(labelled_texts(900, 13, insult))]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    held = {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    said = {r["doc_id"]: r["score"] >= toxicity.CUT for r in toxicity.score(docs, model).collect()}
    right = [said[k] == bool(y) for k, _, y in rows if k in held]
    assert np.mean(right) > 0.95 and min(held) >= 0
    # The held-out labels are not read.
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1).otherwise(F.col("toxic")).cast("int"))
    assert (toxicity.learn(docs, other).vectors == model.vectors).all()


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """Words that stand in few of many texts are learned too, and tasks that share the texts make one model."""
    rows = [(k, t, y) for k, (t, y) in enumerate(labelled_texts(900, 14, insult))]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    outside = sum(zlib.crc32(str(k).encode()) % 3 != 1 for k, _, _ in rows)
    texts = toxicity.labelled_texts(docs, labels, "toxic", folds=3, held=1, text="text", doc_id="doc_id")
    assert toxicity.count_buckets(texts)[1].sum() == outside
    monkeypatch.setattr(toxicity, "TEXTS_A_TASK", 150)
    seen, real = [], toxicity.one_round
    monkeypatch.setattr(toxicity, "one_round", lambda dealt, *more: seen.append(dealt.select("_part").distinct().count()) or real(dealt, *more))
    model = toxicity.learn(docs, labels)
    assert seen == [seen[0]] * toxicity.SHARED_ROUNDS and seen[0] > 1
    said = {r["doc_id"]: r["score"] >= toxicity.CUT for r in toxicity.score(docs, model).collect()}
    assert np.mean([said[k] == bool(y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]) > 0.9


def test_score_of_long_texts_is_that_of_all_words():
    model = toxicity.Model.new(1)
    filler = "word " * 30000
    assert model.scores([filler + "moron"])[0] != model.scores([filler + "other"])[0]


def junk(draw, text):
    return [w + draw.choice(["%%%", "###", "&&&"]) for w in text]


def test_quality_learns_from_positives_alone(spark):
    rows = [(k, t, 1 - y) for k, (t, y) in enumerate(labelled_texts(1600, 14, junk))]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 2], "doc_id long, quality int").unionByName(
        spark.createDataFrame([(k, y) for k, _, y in rows if k % 8 == 4], "doc_id long, quality int"))
    model = pu_quality.learn(docs, labels)
    assert 0.4 < model.prior < 0.9
    said = {r["doc_id"]: r["score"] >= pu_quality.CUT for r in pu_quality.score(docs, model).collect()}
    assert np.mean([said[k] for k, _, y in rows if y]) > 0.97
    assert np.mean([said[k] for k, _, y in rows if not y]) < 0.3
    # What is labelled bad is never read.
    flipped = labels.where("quality = 1").unionByName(labels.where("quality = 0").withColumn("quality", F.lit(0)))
    assert np.allclose(pu_quality.learn(docs, flipped).bins, model.bins)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    prior = pu_quality.class_prior(good[:2000], np.concatenate([good[2000:3400], bad[:600]]))
    assert abs(prior - 0.7) < 0.06


@pytest.mark.parametrize("module", [toxicity, pu_quality])
def test_classifier_edges(spark, edge, nothing, module):
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None), (6, 0), (7, 1)], f"doc_id long, {label} int")
    for taught in (labels, labels.limit(0)):
        model = module.learn(edge, taught)
        out = module.score(edge, model)
        assert out.columns.count("score") == 1 and out.count() == edge.count()
        scores = [r["score"] for r in out.select("doc_id", "score").collect()]
        assert all(s is not None and 0 <= s <= 1 for s in scores)
        assert len({r["score"] for r in out.where("text IS NULL OR text = ''").collect()}) == 1
    assert module.score(nothing, model).count() == 0


def test_a_repeated_id_is_one_text_of_a_sample(spark, monkeypatch):
    rows = [(1, f"copy {k} of one id") for k in range(80)] + [(k, f"text {k}") for k in range(2, 60)]
    labels = spark.createDataFrame([(k, int(k % 2 == 1), int(k % 2 == 1)) for k in range(1, 40)], "doc_id long, toxic int, quality int")
    seen = []
    monkeypatch.setattr(pu_quality, "train", lambda good, rest: seen.append((good, rest)))
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        texts, marks, _ = toxicity.labelled_sample(docs, labels, "toxic", folds=3, held=9, most=10)
        assert len(texts) == 20 and marks.tolist() == [0] * 10 + [1] * 10 and len(set(texts)) == 20
        pu_quality.learn(docs, labels, positives=15, unlabelled=30)
        seen.append(texts)
    assert seen[0] == seen[2] and seen[1] == seen[3]
    good, rest = seen[0]
    assert len(good) == 15 and len(set(rest)) == 30
    # All twenty rows without a label are in the mixture, which is filled up from the others.
    assert {f"text {k}" for k in range(40, 60)} <= set(rest)


# ---- pipeline --------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables: insults, copies, near copies, shared lines, nulls, junk."""
    draw = random.Random(15)
    rows = []
    for k, (text, toxic) in enumerate(labelled_texts(400, 16, insult)):
        rows.append((k, text, "en", f"s{k % 5}", len(text), toxic))
    base = " ".join(f"plain{j} text{j}" for j in range(60))
    for k in range(400, 420):
        words = base.split()
        words[draw.randrange(len(words))] = f"new{k}"
        rows.append((k, " ".join(words) if k % 2 else base, "en", "s1", 10, 0))
    shared = "\n".join(f"shared line number {j} of many" for j in range(5))
    rows += [(k, f"own start {k}\n{shared}\nown end {k} " + " ".join(f"u{k}x{j}" for j in range(30)), "en", "s2", 10, 0) for k in range(430, 445)]
    rows += [(500, None, None, None, None, None), (501, "", "en", "s1", 0, 0), (None, "a text without id but with words " + "z " * 20, "en", None, 5, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic int"
    frame = spark.createDataFrame(rows, schema)
    frame.drop("toxic").repartition(3).write.parquet(f"{folder}/documents.parquet")
    frame.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == columns
    toxic = {k for k, *_, y in rows if y}
    clean = {r[0] for r in rows} - toxic
    after = {r[0] for r in kept["toxicity"].select("doc_id").collect()}
    assert len(toxic & after) <= 0.1 * len(toxic) and len(clean - after) <= 0.03 * len(clean)
    lines = {r["doc_id"]: r for r in kept["line_dedup"].collect()}
    assert "shared line number 2" in lines[430]["text"] and all("shared line number 2" not in lines[k]["text"] for k in range(431, 445))
    assert lines[435]["n_chars"] == len(lines[435]["text"]) and set(lines) <= after and 500 in lines
    # One document of each group, by brute force on the stage's own input.
    ids = [(r["doc_id"], r["text"]) for r in kept["line_dedup"].collect() if r["doc_id"] is not None]
    groups = {i: g for i, g, *_ in brute_join(ids)}
    stay = {r[0] for r in kept["ngram_jaccard"].select("doc_id").collect()}
    assert stay - {None} == set(groups.values()) and kept["ngram_jaccard"].count() == len(stay)
    mixed = [r[0] for r in kept["source_mix"].select("doc_id").collect()]
    assert set(mixed) <= stay and all(mixed.count(k) <= 2 for k in set(mixed))
    texts = {(r["doc_id"], r["text"]) for r in kept["ngram_jaccard"].collect()}
    assert {(r["doc_id"], r["text"]) for r in kept["source_mix"].collect()} <= texts
    import hashlib

    decoded = sorted((r["doc_id"] is None, r["doc_id"], r["decoded_sha256"]) for r in kept["byte_bpe"].collect())
    assert decoded == sorted((r["doc_id"] is None, r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept["source_mix"].collect())


def test_pipeline_of_nothing(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        assert docs.count() == 0


MADE = ("n_lines n_removed _toxicity _key _head _head_id _first size source_size target spans span taken _row _id _hash _text _cut "
        "_source _size _order key class_key score").split()


def test_columns_of_any_name_pass_through(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain, named = docs, docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in MADE})
    named = named.withColumn("_map", F.create_map(F.lit("id"), F.col("doc_id")))
    columns = named.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        named = corpus_pipeline.cut_lineage(stage(spark, named, folder))
        plain = corpus_pipeline.cut_lineage(stage(spark, plain, folder))
        assert named.columns == columns, name
        assert sorted(map(str, named.select(*docs.columns).collect())) == sorted(map(str, plain.collect())), name
        wrong = [F.col(n) != F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in MADE]
        for condition in wrong:
            assert named.where(condition).isEmpty(), (name, condition)


def test_which_copy_stays_is_settled(spark, corpus):
    """Rows of one id and one text differ in source and lang alone; any partitioning keeps the same one."""
    rows = [(7, "the same seven words stand in all", lang, source, 33) for lang in ("en", "fr", None) for source in ("a", "b", None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {tuple(corpus_pipeline.drop_near_copies(spark, docs.repartition(n, "lang", F.rand(n)), corpus[0]).first()) for n in (1, 3, 7)}
    assert len(kept) == 1


def test_mix_of_repeated_ids_agrees(spark):
    """Documents of one id and one size have one share each, whatever the partitioning; null ids are spread."""
    draw = random.Random(4)
    rows = [(draw.choice([1, 2, None]), " ".join(f"w{draw.randrange(900)}" for _ in range(20)), draw.choice(["a", "b"])) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = []
    for parts in (3, 7):
        mixed = mixing.mix(docs.repartition(parts), whole=True)
        runs.append(sorted((r["text"], r["source"], r["taken"], str(r["spans"])) for r in mixed.collect()))
    assert runs[0] == runs[1]


def test_run_applies_all_stages(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).columns[0] == "doc_id" and len(corpus_pipeline.STAGES) == 5
    assert line_windows.WINDOW == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_training_shuffle_no_text(spark, monkeypatch):
    rows = [(k, t, y) for k, (t, y) in enumerate(labelled_texts(600, 15, insult))]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TEXTS_A_TASK", 100)
    seen, real = [], toxicity.one_round
    monkeypatch.setattr(toxicity, "one_round", lambda dealt, *more: seen.append(plan_of(dealt.groupBy("_part").agg(F.max("text")))) or real(dealt, *more))
    toxicity.learn(docs, labels)
    assert len(seen) == toxicity.SHARED_ROUNDS and not any("Exchange" in plan for plan in seen)


def test_starts_meet_the_documents_without_a_second_shuffle_of_them(spark, edge):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mix(edge.select("doc_id", "source", "text"), whole=True)
        plan = plan_of(mixed)
        taken = sorted((r["source"] or "", r["source_size"], r["taken"] > 0) for r in mixed.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The documents by source and bucket, and three short lists: their sums, the sums in order, and the sums to the documents.
    assert plan.count("Exchange hashpartitioning") <= 4 and len(taken) == edge.count()
