"""The pipeline's stages against plain versions on a small corpus with planted cases."""

import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import toxicity
from lattica.llm.queries import PIECES_FILE
from lattica.llm.sentencepieces import Pieces

FOUL = ["vilething", "awfulthing", "nastything"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 4000, n)]


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    texts, kind = {}, {}

    def put(name, text):
        i = len(texts)
        texts[i], kind[i] = text, name
        return i

    for i in range(240):
        own = words(rng, int(rng.integers(60, 160)))
        foul = i % 4 == 0
        for at in rng.choice(len(own), 6 if foul else 0, replace=False):
            own[at] = FOUL[at % 3]
        put("toxic" if foul else "clean", " ".join(own))
    labelled = list(texts)
    base = [i for i in texts if kind[i] == "clean"][:12]
    copies, near = {}, {}
    for i in base[:6]:
        for _ in range(3):
            copies[put("copy", texts[i].upper())] = i
    for i in base[6:]:
        own = texts[i].split()
        for _ in range(3):
            other = list(own)
            other[int(rng.integers(5, len(own) - 5))] = f"new{len(texts)}"
            near[put("near", " ".join(other))] = i
    items = [f"On day {k} Anna walks {k + 3} km to the old mill and then she carries {k + 7} sacks of the finest flour to the town {k}" for k in range(5)]
    leaks = [put("leak", " ".join([*words(rng, 60), item.replace("Anna", "Berta").replace("sacks", "sacks"), *words(rng, 60)])) for item in items]
    for t in (None, "", "short one", " \n", "x" * 30_000):
        put("edge", t)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    rows += [(None, "a text without an id " * 3, None, None, None), (None, "a text without an id " * 3, "en", None, 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(7)).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(kind[i] != "toxic"), int(kind[i] == "toxic")) for i in labelled]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, kind, copies, near, leaks


@pytest.fixture(scope="module")
def stages(spark, case):
    folder, *_ = case
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs)
    return out


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)


def test_stages_keep_the_columns_of_documents(spark, case, stages):
    names = spark.read.parquet(f"{case[0]}/documents.parquet").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "sentencepiece"]
    assert all(s.columns == names for s in stages[:3])


def test_toxicity_stage_equals_brute_force(spark, case, stages):
    """P(grade >= 1) from the model's weights, a text's words and word beginnings being looked up one by one."""
    folder, rows, kind, *_ = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, toxicity.grades_of(spark.read.parquet(f"{folder}/labels.parquet")))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))

    def toxic(text):
        told = set()
        for raw in (text or "").encode().lower().split():
            word = raw.strip(toxicity.EDGES).decode()
            told |= {"=" + word, *(word[:k] for k in range(4, min(len(word), 10)))} if word else set()
        seen = {xxhash.xxh3_64_intdigest(x.encode()) >> 64 - model.params.bits for x in told}
        return 1 / (1 + math.exp(model.thresholds[0] - sum(weight.get(b, 0.0) for b in seen))) > model.params.reject_at

    assert ids(stages[0]) == sorted((i for i, t, *_ in rows if not toxic(t)), key=str)
    kept = set(ids(stages[0]))
    assert not kept & {i for i, k in kind.items() if k == "toxic"}
    assert kept >= {i for i, k in kind.items() if k in ("clean", "copy", "near", "edge", "leak")}
    repeated = toxicity.train(docs.unionByName(docs), toxicity.grades_of(spark.read.parquet(f"{folder}/labels.parquet")))
    assert repeated.buckets.tolist() == model.buckets.tolist() and np.allclose(repeated.weights, model.weights)


def test_near_duplicate_stage_equals_brute_force(case, stages):
    def shingles(text):
        own = (text or "").lower().split()
        return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()

    before = [(r.doc_id, r.text) for r in stages[0].collect()]
    sets, up = [shingles(t) for _, t in before], list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if up[i] != up[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if u == old else u for u in up]
    first = {u: min((before[k][0] for k in range(len(up)) if up[k] == u and before[k][0] is not None), default=None) for u in set(up)}
    assert ids(stages[1]) == sorted(first.values(), key=str)
    assert not set(ids(stages[1])) & {*case[3], *case[4]}


def test_decontamination_stage_drops_leaks_only(case, stages):
    assert sorted(set(ids(stages[1])) - set(ids(stages[2])), key=str) == sorted(case[5])


def test_last_stage_encodes_all_that_is_left(case, stages):
    own, texts = Pieces(open(PIECES_FILE, "rb").read()), {r.doc_id: r.text for r in stages[2].collect()}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].ids == own.encode(t) and own.decode(got[i].ids) == (t or "")
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].n_ids == len(got[i].ids)


def test_run_is_the_stages_in_order(spark, case, stages):
    got = sorted((str(r.doc_id), r.decoded_sha256) for r in corpus_pipeline.run(spark, case[0]).collect())
    assert got == sorted((str(r.doc_id), r.decoded_sha256) for r in stages[3].collect())


def test_empty_documents(spark, case, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{case[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
