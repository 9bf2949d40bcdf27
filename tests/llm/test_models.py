import random

import numpy as np
import public_tokenizers
import pytest

from tidelog.llm import language_id, piece_codec, quality_rules
from tidelog.llm.packing import best_fit, pack
from tidelog.llm.token_counts import token_counts

JSON, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  two  spaces", "tab\there\nnl ", "日本語 テキスト", "a<|endoftext|>b <|startoftext|>", "ﬁ Å Å İstanbul", "don't we'll 'S", "a▁b", " ", "x" * 3000, " em nb", "<s> <0x41>"]


def with_odd(spark, docs):
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string"))


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    rows = with_odd(spark, docs)
    tokenizer = Tokenizer.from_file(JSON)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False))) for r in rows.collect())
    got = token_counts(rows, JSON, 300).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 300) for r in got)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((r["doc_id"] or -1, len(processor.encode(r["text"] or ""))) for r in rows.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts(rows, MODEL).collect()) == want


def test_piece_codec(spark, docs):
    import sentencepiece

    rows = with_odd(spark, docs)
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = piece_codec.encode(rows, MODEL)
    got = encoded.collect()
    assert all(r["parity"] and r["round_trip"] for r in got)
    want = sorted((r["doc_id"] or -1, np.array(processor.encode(r["text"] or ""), "<i4").tobytes()) for r in rows.collect())
    assert sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in got) == want
    decoded = sorted((r["doc_id"] or -1, r["text"]) for r in piece_codec.decode(encoded, MODEL).collect())
    assert decoded == sorted((r["doc_id"] or -1, processor.decode(processor.encode(r["text"] or ""))) for r in rows.collect())


def test_texts_without_spaces_are_cut_where_no_piece_lies_across():
    """Ids are those of the library, and what a worker remembers stays small, however many long words it meets."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = piece_codec.Codec(MODEL)
    rng = random.Random(3)
    scripts = [(0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x430, 0x44F), (0x61, 0x7A), (0x1F600, 0x1F640)]
    texts = ["".join(chr(rng.randrange(*scripts[rng.randrange(len(scripts)) if i % 3 else i % len(scripts)])) for _ in range(rng.randrange(1, 3000))) for i in range(60)]
    texts += ["a" * 5000, "ab" * 3000, " " * 700 + "x" * 700, "的" * 4000 + " " + "是的" * 100, "", "x", "▁" * 300]
    for text, (ids, parity, trip) in zip(texts, codec.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == processor.encode(text) and parity and trip
    for word in codec.pieces(codec.normalise("的是不" * 2000)):
        assert len(word) <= piece_codec.LONG
    assert max(map(len, codec.known)) <= 6001  # "abab...", whose characters all stand together in pieces


def test_words_are_forgotten_by_their_bytes(monkeypatch):
    monkeypatch.setattr(piece_codec, "MOST_KNOWN", 100_000)
    codec, rng = piece_codec.Codec(MODEL), random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)) for _ in range(30)] + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))]
    first = codec.encode_batch(texts)
    assert codec.held <= 3 * 100_000 and all(parity and trip for _, parity, trip in first)
    assert codec.encode_batch(texts[::-1]) == first[::-1]


def test_unigram_model_is_rebuilt():
    pieces = [("<unk>", 0.0, piece_codec.UNKNOWN), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("a", -3.0, 1), ("▁", -2.5, 1)]
    tokenizer, _ = piece_codec.build(piece_codec.PieceModel(pieces, piece_codec.UNIGRAM, b"", True, False))
    assert tokenizer.encode("ab", add_special_tokens=False).tokens == ["▁a", "b"]
    assert tokenizer.decode([1, 2], skip_special_tokens=False) == " ab"


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"aa": ["kol", "mir", "tas", "ün"], "bb": ["zhe", "qui", "vor", "éw"]}
    text = lambda lang, n: " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(3, 400)), lang if i % 7 else None) for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "123 ... 456", "bb"), (None, text("aa", 50), "aa"), (5, rows[5][1], "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language_id.fit(docs, texts_each=75)
    got = {r["doc_id"]: r for r in language_id.language_id(docs, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (300, 301, 302))
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert not got[None]["held_out"] and got[None]["lang_pred"] == "aa"
    held = [i for i in range(300) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == ("aa", "bb")[i % 2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = docs.limit(0)
    assert language_id.fit(empty) is None and language_id.language_id(empty, None).count() == 0


def test_all_languages_are_learned_within_bounds(spark):
    """More languages than texts are allowed: each has one; and a language's texts stay within its share of the bytes."""
    rows = [(100 * k + i, chr(97 + k % 26) + chr(97 + k // 26) + " " + "xy " * (20 if i else 2000), f"l{k:03d}", 1) for k in range(80) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, count bigint")
    assert len(language_id.fit(docs, texts_each=2, most_texts=40).languages) == 80
    taken = []
    keep, language_id.train = language_id.train, lambda windows, labels, languages: taken.append(np.bincount(labels)) or languages
    try:
        assert len(language_id.fit(docs, texts_each=5, most_texts=80 * 3, most_bytes=80 * 150)) == 80
    finally:
        language_id.train = keep
    # Texts of 63 bytes have one window each; two of them are what fits into 150 bytes.
    assert (taken[0] == 2).all()


def small_net(seed=3):
    rng = np.random.default_rng(seed)
    filters = [rng.normal(size=(k * language_id.EMBED, language_id.FILTERS)) for k in language_id.WIDTHS]
    shifts = [rng.normal(size=language_id.FILTERS) for _ in language_id.WIDTHS]
    return language_id.ByteNet(["a", "b", "c"], rng.normal(size=(256, language_id.EMBED)), filters, shifts, rng.normal(size=(language_id.FILTERS * len(language_id.WIDTHS), 3)), rng.normal(size=3))


def test_predict_against_direct_convolution():
    """Each filter at each place of each window, one product at a time."""
    net, windows = small_net(), np.random.default_rng(4).integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    want = []
    for window in windows:
        features = []
        for k, w, shift in zip(language_id.WIDTHS, net.filters, net.shifts, strict=True):
            for f in range(language_id.FILTERS):
                places = [sum(net.embed[window[i + j]][e] * w[j * language_id.EMBED + e, f] for j in range(k) for e in range(language_id.EMBED)) + shift[f] for i in range(language_id.WINDOW - k + 1)]
                features.append(max(max(places), 0.0))
        z = np.exp(np.array(features) @ net.out + net.bias - 50)
        want.append(z / z.sum())
    assert net.predict(windows, net.tables()) == pytest.approx(np.array(want), abs=1e-9)


def test_gradients_of_the_network_against_differences():
    net, rng = small_net(), np.random.default_rng(5)
    x, y = rng.integers(0, 256, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    net.out *= 0.05
    _, grads = language_id.gradients(net, x, y)
    for p, g in zip([net.embed, *net.filters, *net.shifts, net.out, net.bias], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        whole = p[at]
        p[at] = whole + 1e-6
        up = language_id.gradients(net, x, y)[0]
        p[at] = whole - 1e-6
        down = language_id.gradients(net, x, y)[0]
        p[at] = whole
        assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_language_id_learns_rare_languages_and_ignores_other_columns(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["kolan", "mirek", "tasun"]) for _ in range(9)), "aa", "x") for i in range(400)] + [(1000 + i, " ".join(rng.choice(["zhequi", "vorzhe"]) for _ in range(9)), "zz", "y") for i in range(12)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    net = language_id.fit(made, texts_each=20)
    assert net.languages == ["aa", "zz"]
    long = spark.createDataFrame([(1, "kolan mirek " * 20_000, "zz", "s"), (1, "kolan mirek " * 20_000, None, "s")], made.schema)
    assert {tuple(r)[1:3] for r in language_id.language_id(long, net).collect()} == {(False, "aa")}
    tied = language_id.ByteNet(["aa", "zz"], *(np.zeros_like(x) if isinstance(x, np.ndarray) else [np.zeros_like(w) for w in x] for x in (net.embed, net.filters, net.shifts, net.out, net.bias)))
    assert {tuple(r)[2:] for r in language_id.language_id(long, tied).collect()} == {("aa", 0.5)}
    assert language_id.language_id(docs, net).count() == docs.count()


def test_windows_cover_all_bytes():
    text = bytes(random.Random(2).randrange(1, 256) for _ in range(1000))
    windows, owner = language_id.cut([text, b"", b"ab"])
    step = language_id.WINDOW - language_id.OVERLAP
    own = windows[owner == 0]
    assert b"".join(bytes(w[:step]) for w in own[:-1]) + bytes(own[-1]).rstrip(b"\0") == text
    assert [int((owner == i).sum()) for i in (1, 2)] == [1, 1]


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    runs = {}
    for i in range(len(words) - 4):
        runs.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(rows):
    texts = [t or "" for _, t in rows] + ["a b c d e f a b c d e g\nx|y\nx|y\n\n\n", "# * $ é"]
    assert quality_rules.base_counts(texts) == [brute_counts(t) for t in texts]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        field = quality_rules.LineField(rng.normal(size=(2, quality_rules.FEATURES)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, quality_rules.FEATURES))
        e = x @ field.emission.T

        def score(path, e=e, field=field):
            return sum(e[i, p] for i, p in enumerate(path)) + sum(field.transition[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(((k >> np.arange(n)) & 1 for k in range(2**n)), key=score)
        assert field.decode(x).tolist() == best.tolist()


def test_gradients_of_the_field_against_differences():
    rng = np.random.default_rng(2)
    sequences = [rng.normal(size=(n, quality_rules.FEATURES)) for n in (9, 8)]
    ((_, x, real),) = quality_rules._batches(sequences)
    y = rng.integers(0, 2, x.shape[:2])
    weights = [rng.normal(size=(2, quality_rules.FEATURES)), rng.normal(size=(2, 2))]
    _, *grads = quality_rules.gradients(quality_rules.LineField(*weights), x, real, y)
    for p, g in zip(weights, grads, strict=True):
        for at in np.ndindex(2, 2):
            p[at] += 1e-6
            up = quality_rules.gradients(quality_rules.LineField(*weights), x, real, y)[0]
            p[at] -= 2e-6
            down = quality_rules.gradients(quality_rules.LineField(*weights), x, real, y)[0]
            p[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_lines_of_mixed_texts():
    """Content and boilerplate in one text get labels of their own, although only whole texts are labelled."""
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"]) + "abcdefgh"[rng.randrange(8)]
    content = lambda: " ".join(word() for _ in range(rng.randrange(6, 12))) + "."
    junk = lambda: " | ".join(f"x{rng.randrange(1000)}" for _ in range(rng.randrange(4, 9)))
    kept = [[content() for _ in range(rng.randrange(3, 9))] for _ in range(80)]
    dropped = [[content()] * (i % 2) + [junk() for _ in range(rng.randrange(3, 9))] for i in range(40)]
    features, sizes = zip(*[quality_rules.line_features("\n".join(t)) for t in kept + dropped], strict=True)
    field = quality_rules.train(list(features), list(sizes), [True] * 80 + [False] * 40)
    right = total = 0
    for _ in range(50):
        kinds = [rng.randrange(2) for _ in range(8)]
        text = "\n".join(content() if k else junk() for k in kinds)
        right += sum(a == b for a, b in zip(field.decode(quality_rules.line_features(text)[0]), kinds, strict=True))
        total += 8
    assert right > 0.95 * total


def test_quality_rules(spark, docs, none):
    rng = random.Random(4)
    clean = lambda: ".\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(10**6)) for _ in range(9)) for _ in range(4)) + "."
    junk = lambda: "\n".join(" | ".join(f"x{rng.randrange(10**6)}" for _ in range(9)) for _ in range(4))
    rows = [(i, clean() if i % 4 else junk()) for i in range(200)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    field = quality_rules.fit(made, labels)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(made, field).collect()}
    assert all(got[i]["kept"] == (i % 4 > 0) for i in range(200))
    assert sorted(r["doc_id"] for r in quality_rules.keep_quality(made, field).collect()) == [i for i in range(200) if i % 4]
    odd = quality_rules.quality_rules(docs, None).collect()
    assert len(odd) == docs.count()
    assert all(not r["kept"] for r in odd if r["n_words"] < 10) and any(r["kept"] for r in odd)
    assert quality_rules.fit(none, labels) is None and quality_rules.quality_rules(none, field).count() == 0
    assert quality_rules.keep_quality(docs, None).columns == docs.columns


def test_pack_takes_the_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(30):
        pieces = sorted(((rng.randrange(1, 60), rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3])) for _ in range(60)), key=lambda p: -p[0])
        bins: list = []
        want = []
        for size, source, cluster in pieces:
            fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"].count(source) < 2)]
            if fits:
                i = min(fits)[1]
            else:
                i = len(bins)
                bins.append({"left": 100, "clusters": [], "sources": []})
            bins[i]["left"] -= size
            bins[i]["clusters"].append(cluster)
            bins[i]["sources"].append(source)
            want.append(i)
        assert pack([p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], 100, 2) == want


def test_counts_join_common_and_rare_pieces(spark, docs, monkeypatch):
    """However few pieces are broadcast, the counts are the same; texts of tokenizers that cross white space are encoded whole."""
    from tokenizers import Tokenizer

    from tidelog.llm import token_counts as module

    rows = with_odd(spark, docs).collect()
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(len(Tokenizer.from_file(JSON).encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    for most in (0, 30):
        monkeypatch.setattr(module, "MOST_COMMON", most)
        assert sorted(r["n_tokens"] for r in token_counts(table.withColumn("piece", table.text), JSON).collect()) == want
    bytes_json = public_tokenizers.path("byte_bpe_50k.json")
    assert module.ends_at_space(JSON) and not module.ends_at_space(bytes_json)
    want = sorted(len(Tokenizer.from_file(bytes_json).encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted(r["n_tokens"] for r in token_counts(table, bytes_json).collect()) == want
    empty = table.limit(0)
    assert token_counts(empty, JSON).count() == token_counts(empty, MODEL).count() == piece_codec.encode(empty, MODEL).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (1, None, 2)], "doc_id bigint, ids binary, text int")
    assert [tuple(r) for r in piece_codec.decode(odd, MODEL).orderBy("doc_id").collect()] == [(None, ""), (1, "")]


def test_bytes_that_are_no_characters_decode_as_in_the_library():
    codec = piece_codec.codec(MODEL)
    of_byte = {bytes([int(p[3:5], 16)]): i for i, (p, _, kind) in enumerate(codec.model.pieces) if kind == piece_codec.BYTE}
    for data in (b"\xff", b"a\xc3", b"\xe6\x97\xa5", b"\xc3\xa9\xc3"):
        ids = np.array([of_byte[bytes([x])] for x in data], "<i4")
        assert codec.decode(ids) == codec.tokenizer.decode(ids.tolist(), skip_special_tokens=False).removeprefix(" ")


def test_unsupported_models_are_refused():
    for field_, value in ((3, b"\x28\x00"), (2, b"\xc0\x01\x01"), (2, b"\x18\x03")):
        with pytest.raises(ValueError):
            piece_codec.parse_model(bytes([field_ << 3 | 2, len(value)]) + value)


def test_a_bin_takes_few_pieces_of_a_source(spark):
    rows = [(i, f"{i} b c", "s" if i < 40 else None, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, bin_id bigint")
    bins: dict = {}
    for r in best_fit(docs, 30, 2).collect():
        bins.setdefault(r["bin_id"], []).append(r["doc_id"] < 40)
    assert max(sum(b) for b in bins.values()) == 2
    assert best_fit(docs.drop("source"), 30, 2).select("bin_id").distinct().count() == 6


@pytest.mark.parametrize("shard_rows", [5, 2048])
def test_best_fit(docs, rows, none, shard_rows):
    capacity = 130
    got = best_fit(docs, capacity, 2, shard_rows).collect()
    n_words = lambda t: len((t or "").encode().split())
    want = sorted((i if i is not None else -1, p, p * capacity, min(capacity, n_words(t) - p * capacity)) for i, t in rows for p in range(max(1, -(-n_words(t) // capacity))))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["n_words"]) for r in got) == want
    assert all((r["bin_id"] is None) == (r["n_words"] == 0) for r in got)
    fill: dict = {}
    for r in got:
        if r["bin_id"] is not None:
            fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["n_words"]
    assert max(fill.values()) <= capacity
    copies = [r["bin_id"] for r in got if r["doc_id"] in (7, 8) and r["piece"] == 0]
    assert len(copies) == len(set(copies)) == 4
    assert best_fit(none).count() == 0
