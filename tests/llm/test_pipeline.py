"""The pipeline against plain Python, stage by stage on each stage's own input."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lorekit.llm import quality_classifier as C
from lorekit.llm import sentencepiece_viterbi as S
from lorekit.llm.text_features import block_counts
from test_lines_and_mix import boilerplate, plan
from test_shingle_length import firsts
from test_tokens import brute
from tests_llm import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, SF).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((docs, got))
        docs = got
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join",
                                                      "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, stages):
    before, after = stages[0]
    model = C.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    good = []
    for d, t, s in rows(before):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        if C.score(model, C.features(block_counts(np.array([0, len(raw)]), raw, windows=False)[0]))[0] >= 0.5:
            good.append((d, t, s))
    assert Counter(rows(after)) == Counter(good)


def test_lines(stages):
    before, after = (rows(x) for x in stages[1])
    bad, want = boilerplate(before), []
    for d, t, s in before:
        cut = "\n".join(x for x in t.split("\n") if bad.get(x, d) == d)
        if cut == t or words(cut):
            want.append((d, cut, s))
    assert Counter(after) == Counter(want)


def test_near_duplicates(stages):
    """Five words and a similarity of 0.8, as for every stage on shingles."""
    before, after = (rows(x) for x in stages[2])
    first = firsts(before)
    assert Counter(after) == Counter(r for r in before if r[0] in first)


def test_mix(stages):
    before, after = (rows(x) for x in stages[3])
    sizes, by = defaultdict(int), defaultdict(list)
    for r in before:
        sizes[r[2]] += len(words(r[1]))
        by[r[2]].append((int(hashlib.md5(str(r[0]).encode()).hexdigest()[:12], 16), r))
    want = Counter()
    for s, target in plan(sizes).items():
        passes = int(target // sizes[s])
        budget, below = target - passes * sizes[s], 0
        for _, r in sorted(by[s]):
            n = len(words(r[1]))
            more = below + n <= budget or below < budget and 2 * (budget - below) >= n
            want[r] += passes + more
            below += n
    assert Counter(after) == +want


def test_tokens(stages):
    import sentencepiece
    before, after = stages[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    pieces, memo = S.load_pieces(), {}
    scores = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    texts = Counter((d, t) for d, t, _ in rows(before))
    got = after.collect()
    assert Counter(r.doc_id for r in got) == Counter(d for (d, _), n in texts.items() for _ in range(n)) and all(r.round_trip for r in got)
    ids = {r.doc_id: list(r.token_ids) for r in got}
    for (d, t), _ in texts.items():
        want = []
        for w in t.split(" ") if t else []:
            if w not in memo:
                memo[w] = brute(chr(S.SPACE) + w, scores, pieces)
            want += memo[w]
        assert ids[d] == want


def test_run_and_registration(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == Counter((r.doc_id, r.n_tokens) for r in stages[-1][1].collect())
    names = [n for n in entry.queries() if n == "pipeline" or n.startswith("op") and n[2:3].isdigit()]
    assert len(names) == 14 and {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def stage_by_stage(spark, folder, rows, labels):
    """Rows after each stage over documents of their own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, None, s, None if t is None else len(t)) for d, t, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs)
    return out


def test_empty_documents(spark, tmp_path):
    assert [d.count() for d in stage_by_stage(spark, str(tmp_path), [], [])] == [0] * 5


def test_messy_documents(spark, tmp_path, messy_rows):
    """Nothing is learned from no labels, so no document goes for its quality; null ids, texts and sources go through."""
    out = stage_by_stage(spark, str(tmp_path), messy_rows, [])
    assert Counter(rows(out[0])) == Counter(messy_rows)
    bad = boilerplate(messy_rows)
    cut = [(d, t if t is None else "\n".join(x for x in t.split("\n") if bad.get(x, d) == d), s) for d, t, s in messy_rows]
    assert Counter(rows(out[1])) == Counter(r for r, (_, t, _) in zip(cut, messy_rows) if r[1] == t or words(r[1]))
    first = firsts([r for r in rows(out[1]) if r[0] is not None])
    assert Counter(rows(out[2])) == Counter(r for r in rows(out[1]) if r[0] is None or r[0] in first)
    texts = Counter(r[1] or "" for r in rows(out[3]))
    got = out[4].collect()
    assert len(got) == sum(texts.values()) and all(r.round_trip for r in got)
