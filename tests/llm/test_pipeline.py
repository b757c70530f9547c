"""Each stage of the pipeline against a plain version of it, and the whole run."""

import re
import unicodedata
from collections import Counter

import brute
import corpus_pipeline
import pytest
from hostile import texts

from trefoil.llm import pii
from trefoil.llm.tokens import vocabulary


def passes(text):
    n, chars, symbols, dup, _, failed = brute.quality(text)
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
    lower = sum(unicodedata.category(c) == "Ll" for c in text or "")
    return not failed and not (
        10 * symbols > n or chars < 2 * n or chars > 15 * n or 2 * dup > text.count("\n") + 1
        or 5 * text.count("!") > n or upper > 2 * lower or 2 * sum(c in "0123456789" for c in text) > chars
    )


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())] + [(None, texts()[24], None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def found(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    before = found(docs)

    docs = stages["quality rules"](spark, docs, folder)
    want = [r for r in before if passes(r[1])]
    assert found(docs) == want and docs.columns == columns and want

    docs = stages["line dedup"](spark, docs, folder)
    left, gone = brute.line_dedup(want)
    want = [(d, t) for (d, _), t, g in zip(want, left, gone) if not g or brute.WORD.search(t)]
    assert found(docs) == want and docs.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = stages["n-gram Jaccard join"](spark, docs, folder)
    classes, _ = brute.jaccard([t for _, t in want])
    want = [r for i, r in enumerate(want) if classes[i] == i]
    assert found(docs) == want and docs.columns == columns

    spans = {(r["doc_id"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]): r["spans"] for r in pii.pii_report(docs).collect()}
    spans = {d: s for (d, _), s in spans.items()}
    docs = stages["PII"](spark, docs, folder)
    clean = []
    for d, t in want:
        for kind, a, b in sorted((s.split(":") for s in spans[d].split(",") if s), key=lambda s: -int(s[1])):
            t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b) :]
        clean.append((d, t))
    assert found(docs) == clean and docs.columns == columns
    assert not any(re.search("@[a-z]", t) for _, t in clean)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = Counter()
    for d, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            pieces[d, k, s, len(ids[s : s + 2048]), brute.crc(ids[s : s + 2048])] += 1
    packed = stages["best-fit packing"](spark, docs, folder)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r[n] for n in names) for r in packed.collect()) == pieces
    assert Counter(tuple(r[n] for n in names) for r in corpus_pipeline.run(spark, folder).collect()) == pieces


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
