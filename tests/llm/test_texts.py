"""Operators on texts, on hostile rows, against plain versions."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from trefoil.llm import binary, jaccard, lines, packing, pii, quality, substrings, transducer
from trefoil.llm.tokens import Encoder, vocabulary


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def pairs(docs):
    """Rows in the documented order: by id, nulls last."""
    found = [(r["doc_id"], r["text"]) for r in docs.collect()]
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0))


def test_quality(docs, empty):
    out = quality.judge(docs)
    assert out.columns == [*docs.columns, "quality"]
    got = Counter((r["text"], *r["quality"][:6]) for r in out.select("text", "quality").collect())
    assert got == Counter((t, *brute.quality(t)) for _, t in pairs(docs))
    kept = [r["text"] for r in quality.keep_good(docs).collect()]
    assert not any(t and ("!!" in t or "##" in t) for t in kept)
    assert all(not brute.quality(t)[5] for t in kept)
    assert quality.judge(empty).count() == 0


def test_order_of_rules_changes_no_verdict(docs):
    a = quality.judge(docs, rules=quality.default_rules())
    b = quality.judge(docs, rules=quality.default_rules()[::-1])
    assert rows(a.select("text", "quality.kept"), "text", "kept") == rows(b.select("text", "quality.kept"), "text", "kept")


def test_repeated_words_random(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["quality"]["n_repeat_words"] for r in quality.judge(df).collect()}
    assert all(got[t] == brute.quality(t)[4] for t in texts)


def test_line_dedup(docs, empty):
    out = lines.line_dedup(docs)
    assert out.columns == [*docs.columns[:2], *[c for c in docs.columns[2:]], "lines"]
    texts, gone = brute.line_dedup(pairs(docs))
    got = Counter((r[0], r[1], r[-1]["n_removed"]) for r in out.collect())
    assert got == Counter((d, t, g) for (d, _), t, g in zip(pairs(docs), texts, gone))
    assert lines.line_dedup(empty).count() == 0


def test_near_copies(docs, empty):
    order = pairs(docs)
    classes, links = brute.jaccard([t for _, t in order])
    want = Counter((d, order[c][0], n) for (d, _), c, n in zip(order, classes, links))
    assert rows(jaccard.near_copies(docs), "doc_id", "class_id", "n_links") == want
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(classes))
    assert jaccard.near_copies(empty).count() == 0
    assert jaccard.drop_near_copies(empty).count() == 0


def test_near_copies_in_blocks(spark):
    """A large group of graded copies, dealt into many small blocks, loses no link."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9999)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{rng.randint(0, 9)}" for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute.jaccard(texts)
    got = rows(jaccard.near_copies(df, block=16), "doc_id", "class_id", "n_links")
    assert got == Counter((i, classes[i], links[i]) for i in range(len(texts)))


def test_pruning_bounds():
    """The posterior tail falls below the tolerance just under the bound."""
    from math import comb

    least = jaccard.least_matches(0.8, 1e-6, 128)
    for k, m in enumerate(least):
        n = 32 * (k + 1)
        tail = lambda m: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(docs, empty, hot):
    order = pairs(docs)
    want = Counter((d, len((t or "").encode()), n, r, brute.sha(k), k) for (d, t), (k, n, r) in zip(order, brute.substrings([t for _, t in order], 60)))
    out = substrings.remove_repeats(docs, length=60, anchor=20, hot=hot)
    assert [c for c in docs.columns if c != "text"] == out.columns[: len(docs.columns) - 1]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in out.collect())
    assert got == want
    assert substrings.remove_repeats(empty, with_kept=False).count() == 0


def test_substrings_contract_length(docs):
    order = pairs(docs)
    want = Counter((d, n, r, brute.sha(k)) for (d, _), (k, n, r) in zip(order, brute.substrings([t for _, t in order], 400)))
    out = substrings.remove_repeats(docs, with_kept=False)
    assert rows(out, "doc_id", "n_removed", "n_spans", "kept_sha256") == want


def test_binary_ids(spark, docs, empty):
    from tokenizers import Tokenizer

    path = binary.write_ids(docs, vocabulary("byte_bpe_50k.json"), "leading", 2, block_ids=5000)
    got = sorted(binary.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in pairs(docs)]
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = {}
    for d, t in pairs(docs):
        want.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    start = 0
    for r in got:
        assert r["start"] == start and r["ids"] in want[r["doc_id"]]
        want[r["doc_id"]].remove(r["ids"])
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == brute.crc(r["ids"])
        start += r["n_tokens"]
    path = binary.write_ids(empty, vocabulary("byte_bpe_50k.json"), "leading", 2)
    assert binary.read_ids(spark, path).count() == 0


def test_value_coding():
    rng = np.random.default_rng(1)
    for n in [0, 1, 3, 4, 5, 1000]:
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (binary.decode_values(*binary.encode_values(v), n) == v).all()
    control, data = binary.encode_values(np.array([0, 255, 256, 1 << 24], np.uint32))
    assert control == bytes([0b11010000]) and data == bytes([0, 255, 0, 1, 0, 0, 0, 1])


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_encoder_is_the_library(name, spaces):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    library.encode_special_tokens = True
    mine = Encoder(vocabulary(name), spaces, limit=500)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\x1c", "᠎", " ", "a", "Th", "don't", "'s", "É", "é", "́", "日本", "🙂", "12", "...", "<|endoftext|>", "İ", "Σ", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for i in range(0, len(texts), 100):
        got = mine.batch(texts[i : i + 100])
        for t, ids in zip(texts[i : i + 100], got):
            assert np.frombuffer(ids, mine.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_encoder_marks_after_any_letter(name, spaces):
    """A mark after a letter that is normalised to a letter and a combining mark."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    mine = Encoder(vocabulary(name), spaces)
    letters = [c for c in map(chr, range(0x30000)) if c.isalpha()]
    texts = [c + m for c in letters for m in ".,"] + ["BAK\u0130.", "\u09b9\u09df,", "\u0915\u0958."]
    rng = random.Random(7)
    parts = [".", ",", "a", "Th", "é", "e\u0301", "\u0130", "\u0915", "\u0958", "\u09b9", "\u09df", "\u0a5c", "\u0b5c", "\u0f43", "\ufb2a", " "]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    wanted = library.encode_batch_fast(texts, add_special_tokens=False)
    for t, ids, want in zip(texts, mine.batch(texts), wanted):
        assert np.frombuffer(ids, mine.dtype).tolist() == want.ids, repr(t)


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_encoder_finds_special_tokens(name, spaces):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    mine = Encoder(vocabulary(name), spaces, limit=500, special=True)
    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\t", "a", "Th", "é", ".", ",", "12", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "\x1c", "\u0301"]
    texts = ["one <|endoftext|> two"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t, ids in zip(texts, mine.batch(texts)):
        assert np.frombuffer(ids, mine.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_columns(monkeypatch):
    """Runs told apart for a column at a time: white space of all kinds, marks, nulls, slices, several chunks."""
    import pyarrow as pa

    from trefoil.llm import tokens

    mine = Encoder(vocabulary("byte_bpe_50k.json"), "leading", limit=500, special=True)
    rng = random.Random(21)
    plain = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Th", "é", "\u0301", "ɏ", "×", "÷", ".", ",", "'s", "12", "日本", "“", "—", "x.y", "<|endoftext|>"]
    texts = [None, "", "\n", " ", "."]
    for k in range(3000):
        parts = plain + list(tokens.WHITE + tokens.UNSURE) * (k % 3 == 0)
        texts.append(rng.choice([None, ""]) if k % 50 == 0 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
    wanted = [x.ids for x in mine.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for chunk in (1, 300, 1 << 23):
        monkeypatch.setattr(tokens, "_CHUNK", chunk)
        for kind in (pa.string(), pa.large_string()):
            ids, ends = mine.column(pa.array(["before", *texts, "after"], kind).slice(1, len(texts)))
            assert [x.tolist() for x in np.split(ids, ends)[:-1]] == wanted and len(ids) == ends[-1]
    for some in ([], [None], ["", None]):
        ids, ends = mine.column(pa.array(some, pa.string()))
        assert len(ids) == 0 and ends.tolist() == [0] * len(some)


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_encoder_hands_over_few_texts(name, spaces):
    """New words of any letters go to the library some hundred a text, and a word with a mark is no new word."""
    mine = Encoder(vocabulary(name), spaces, special=True)
    handed, library = [], mine.library

    class Counted:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **options)

    mine.library = Counted()
    rng = random.Random(22)
    words = ["".join(rng.choice("abcdeéèçouß") for _ in range(9)) for _ in range(4000)]
    texts = ["\n".join([" ".join(words[k : k + 5]), words[k + 5] + " " + words[k + 6] + "."]) for k in range(0, 3990, 5)]
    found = mine.batch(texts)
    assert found == [np.array(x.ids, mine.dtype).tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(handed) < (100 if spaces == "leading" else 700)
    if spaces == "dropped":
        # A letter that becomes two pieces: its words are learnt one by one.
        texts = [" ".join(["\u0130" * (k % 50 == 0) + w[::-1] for k, w in enumerate(words)])]
        assert mine.batch(texts) == [np.array(library.encode(texts[0], add_special_tokens=False).ids, mine.dtype).tobytes()]
        return
    size = len(mine.known)
    mine.batch([" ".join(w + m for w in words[:3000] if w.isalpha()) for m in ".,"])
    assert len(mine.known) - size <= 3000


def test_queries_find_special_tokens(spark, tmp_path):
    """The registered queries give the ids of a tokenizer as it comes from the file."""
    from tokenizers import Tokenizer

    from trefoil.llm.q_binary import op3_binary_ids
    from trefoil.llm.q_packing import op9_best_fit_packing

    texts = ["one <|endoftext|> two", "<|startoftext|>a<|endoftext|>.", "plain words."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, name, end in ((op3_binary_ids, "byte_bpe_50k.json", 2), (op9_best_fit_packing, "word_bpe_49k.json", 0)):
        library = Tokenizer.from_file(vocabulary(name))
        want = {i: brute.crc(library.encode(t, add_special_tokens=False).ids + [end]) for i, t in enumerate(texts)}
        assert {r["doc_id"]: r["ids_crc32"] for r in query(spark, str(tmp_path)).collect()} == want


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.encode_special_tokens = True
    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"), "dropped", 0, with_ids=True)
    out = packing.pack(cut)
    got = out.collect()
    want = Counter()
    for d, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[d, k, s, len(ids[s : s + 2048]), brute.crc(ids[s : s + 2048])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(out).collect()}
    for s, parts in held.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and whole[s] == b"".join(p[2] for p in sorted(parts))
    assert packing.pack(packing.pieces(empty, vocabulary("word_bpe_49k.json"), "dropped", 0)).count() == 0


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(4)
    for lengths, slack in [(rng.integers(1, 2049, 20000), 1.01), (np.minimum(2048, rng.lognormal(6, 1, 20000)).astype(int) + 0, 1.01), (rng.integers(600, 760, 9999), 1.01), (np.array([1]), 1)]:
        lengths = np.maximum(lengths, 1)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        used, n = Counter(), 0
        for kind, times in packing.plan(histogram):
            assert sum(l * c for l, c in kind.items()) <= 2048
            n += times
            for l, c in kind.items():
                used[l] += c * times
        assert used == Counter(histogram)
        assert n <= max(-(-int(lengths.sum()) // 2048), -(-len(lengths[lengths > 512]) // 3)) * slack


def test_transducer_is_the_library(docs, empty):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    both = transducer.decode(transducer.encode(docs, path), path)
    for r in both.collect():
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["decoded"] == library.decode(r["ids"]) == (r["text"] or "").replace("▁", " ")
    assert transducer.encode(empty, path).count() == 0
    t = transducer.Transducer(path, limit=300)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "th", "e", "▁", "é", "日", "🙂", "0", "12", "<0x41>", "<s>", "ing", "    ", "​", "!!", "\0"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert t.encode(text).tolist() == library.encode(text), repr(text)
        ids = [rng.randrange(32000) for _ in range(rng.randint(0, 8))]
        assert t.decode([i for i in ids if i > 2 and t.types[i] != transducer.CONTROL]) == library.decode([i for i in ids if i > 2])


def test_pii(docs, empty):
    out = pii.pii_report(docs)
    assert [c for c in docs.columns if c != "text"] == [c for c in out.columns[: len(docs.columns) - 1]][:10] + out.columns[10:11]
    # The report ends with the digest and all spans; counts come before.
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out.collect())
    want = Counter()
    for d, t in pairs(docs):
        found = brute.spans(t)
        want[d, *(sum(s[0] == k for s in found) for k in range(4)), brute.sha(brute.span_text(found))] += 1
    assert got == want
    assert pii.pii_report(empty).count() == 0


def test_pii_random(spark):
    rng = random.Random(9)
    parts = ["1", "23", "4111111111111111", "378282246310005", " ", "-", ".", "+", "(", ")", "@", "a", "b.c", "x_y", "\n", "é", "255", "300"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_report(df).collect():
        base = brute.spans(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.span_text(base)), repr(texts[r["doc_id"]])
        listed = r["spans"].split(",") if r["spans"] else []
        assert set(brute.span_text(base).split(",")) - {""} <= set(listed)


def test_redaction(docs):
    got = rows(pii.redact(docs), "doc_id", "text")
    assert pii.redact(docs).columns == docs.columns
    text = next(t for (d, t), _ in got.items() if d == 23)
    assert text == "mail [EMAIL] or [IP], 256.1.1.1, card [CARD], 4111111111111112 [PHONE]."
    assert sum(got.values()) == docs.count()


def added(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r["doc_id"]]: r["spans"] for r in pii.pii_report(df).collect()}


def test_pii_learns_from_planted_texts(spark):
    """Context decides, also in a table without one base span; no other row changes what a text gets."""
    want = {
        "call (555) 123-4567 now": "phone:5:19", "tel 555-123-4567": "phone:4:16", "order 555-123-4567": "", "isbn 555-123-4567": "",
        "mail eve (at) example (dot) com": "email:5:31", "meet (at) noon. Then": "",
    }
    assert added(spark, list(want)) == want
    for text, spans in want.items():
        assert added(spark, [text]) == {text: spans}


def test_pii_spans_inside_longer_runs(spark):
    want = {
        "card 4111 1111 1111 1111 12/25": "card:5:24", "4111 1111 1111 1111 2027": "card:0:19", "2 4111 1111 1111 1111": "card:2:21",
        "é🙂 pay 4111-1111-1111-1111-2027": "card:7:26", "+1 555 123 4567 2024-01-01": "phone:0:15", "tel 1 555 123 4567 ok": "phone:6:18",
        "1024 2048 4096 8192 16384 32768": "", "card 4111 1111 1111 1112 12/25": "", "7" * 5000: "",
    }
    assert added(spark, list(want)) == want
