"""The pipeline's stages against what they must keep, and the package without this subpackage."""

import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, minhash, secret_scan, toxicity
from quern.llm.common import Workspace
from quern.llm.tokens import load, tokenizer_path
from tests.conftest import DATA, ROOT
from tests.llm.test_operators import classes_of, plain_align, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    space, docs, found = Workspace(spark, "t"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = space.table(stage(spark, docs, DATA), name)
        found.append(docs)
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    calm, unique, fresh, safe, packed = stages
    assert all(x.columns == COLUMNS for x in stages[:4])
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(calm) == ids(docs.join(toxicity.score_documents(docs, model).filter("predicted = 0").select("doc_id"), "doc_id"))
    near = minhash.near_duplicates(calm, Workspace(spark, "t"))
    assert ids(unique) == ids(near.filter("doc_id = component_id")) and len(ids(unique)) < len(ids(calm))
    hits = decontaminate.contaminated(unique, spark.read.parquet(f"{DATA}/benchmark.parquet")).select("doc_id").distinct()
    assert ids(fresh) == ids(unique.join(hits, "doc_id", "left_anti"))
    assert ids(safe) == ids(fresh)
    texts = {r.doc_id: r.text for r in fresh.collect()}
    for r in safe.collect():
        spans = secret_scan.find_spans(texts[r.doc_id])
        assert r.text == secret_scan.redact(texts[r.doc_id], spans) and r.n_chars == len(r.text)
    totals = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert ids(totals) == ids(safe) and totals.filter("n <> t").count() == 0


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1].count()


CLASHING = "_key string, _h string, _blob string, _spans string, _toxicity string, key string, h string, row string, blob string, spans string, comp string"


@pytest.fixture(scope="module")
def odd_stages(spark, tmp_path_factory):
    """All stages on rows with nulls, empties, repeats and ties, a long text and clashing names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    plain = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) BETWEEN 300 AND 900").orderBy("doc_id").limit(3).collect()]
    long = " ".join(f"word{k % 9973}x{k % 31}" for k in range(400_000))
    rows = [(1, None), (2, ""), (2, ""), (None, None), (None, ""), (3, plain[0]), (3, plain[1]), (3, plain[1]), (4, plain[0]), (None, "a lone text without an id"),
            (None, "another lone text without an id"), (5, long), (6, long + " more"), (7, "token=abcdefghijkl said once"), (8, "token=abcdefghijkl said once")]
    extra = CLASHING.count(",") + 1
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * extra) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    space, found = Workspace(spark, "t"), [docs.repartition(3)]
    for name, stage in corpus_pipeline.STAGES:
        found.append(space.table(stage(spark, found[-1], folder), name))
    return folder, found


def test_stages_on_odd_rows(odd_stages):
    _, (docs, calm, unique, fresh, safe, packed) = odd_stages
    assert all(x.columns == docs.columns for x in (calm, unique, fresh, safe)) and calm.count() == docs.count() == fresh.count() + 6
    kept = [(r.doc_id, r.text) for r in unique.collect()]
    assert len(kept) == len(set(kept)) and {(1, None), (2, ""), (7, "token=abcdefghijkl said once")} <= set(kept)
    assert sum(i is None for i, _ in kept) == 3 and sum(i == 3 for i, _ in kept) == 2 and not {4, 6, 8} & {i for i, _ in kept}
    texts = {r.doc_id: r.text for r in safe.filter("doc_id IN (1, 2, 7)").collect()}
    assert texts == {1: None, 2: "", 7: "[REDACTED] said once"} and safe.filter("n_chars <> length(text)").count() == 0
    assert safe.filter("_key = 'x' AND _h = 'x' AND _blob = 'x' AND _spans = 'x' AND _toxicity = 'x' AND row = 'x' AND comp = 'x'").count() == safe.count()
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).filter("doc_id = 5 AND n = t").count() == 1


def test_stages_on_empty_tables(spark, odd_stages):
    folder, (docs, *_) = odd_stages
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_run_against_brute_force(spark, tmp_path):
    """All stages together against plain versions of each: what stays, and the ids that are packed."""
    rng = random.Random(11)
    items = {k: prose(9000 + k, 20) for k in range(4)}
    docs, labels = {}, {}
    for i in range(160):
        words = prose(9100 + i, rng.randint(30, 90)).split(" ")
        if i % 4 == 0:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["vile", "awful", "nasty"])
        labels[i] = int(i % 4 == 0)
        docs[i] = " ".join(words)
    for i in range(160, 200):  # near copies, some of which reach the threshold only by way of others
        words = docs[161 if i > 180 else i % 20 + 1].split(" ") if i != 161 else prose(9500, 80).split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "edited"
        docs[i] = " ".join(words)
    for i in range(200, 220):
        passage = [w if rng.random() < 0.8 else "z" for w in rng.choice(items).split(" ")]
        docs[i] = " ".join(prose(9600 + i, 30).split(" ") + passage + prose(9700 + i, 30).split(" "))
    for i in range(220, 230):
        docs[i] = prose(9800 + i, 40) + f" password = 'abc{i}def' and AKIA{'ABCDEFGH' * 2}{i} " + "0a" * 14
    docs |= {230: None, 231: ""}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    toxic = {i for i, t in docs.items() if len({"vile", "awful", "nasty"} & set((t or "").split())) > 1}
    left = [i for i in docs if i not in toxic]
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in left if (w := (docs[i] or "").split())}
    named = sorted(shingles)
    near = lambda a, b: 100 * len(shingles[named[a]] & shingles[named[b]]) >= 80 * len(shingles[named[a]] | shingles[named[b]])
    roots = classes_of(len(named), near)
    left = sorted({named[r] for r in roots} | ({230, 231} & set(left)))
    assert len(roots) - len(set(roots)) >= 15
    hit = {i for i in left for t in items.values() if plain_align(t.split(" "), (docs[i] or "").split()) >= 10}
    assert len(hit) > 10
    clean = {}
    for i in left:
        text, spans = docs[i] or "", []
        for _, pattern, least in secret_scan.RULES:
            spans += [m.span() for m in re.finditer(pattern, text, re.A) if len(m.group(m.lastindex or 0)) >= least]
        for a, b in sorted(spans, reverse=True):  # they don't overlap here
            text = f"{text[:a]}[REDACTED]{text[b:]}"
        clean[i] = text
    plain = load(tokenizer_path("word_bpe_49k.json"))
    want = {i: [*plain.encode(clean[i], add_special_tokens=False).ids, 1] for i in left if i not in hit}
    got = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    assert got == want and sum("REDACTED" in clean[i] for i in want) == 10


def test_the_rest_imports_without_it():
    code = "import sys; sys.modules['quern.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
