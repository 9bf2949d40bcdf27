"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace marker, pieces with scores (unigram) or merges by
score (BPE) and byte fallback are rebuilt as one ``tokenizers.Tokenizer``. Where no piece has the marker behind
another character, no piece crosses the start of a word, so words are encoded on their own: each task encodes a
distinct word once, in multithreaded batches, and holds it against the sentencepiece library. A very long word, as
in scripts without spaces, is cut between two characters that stand together in no piece.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed values of the model format: the marker, and the types of pieces and models.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A worker forgets its words when they hold so many bytes; they are then encoded anew, so results don't depend on it.
MOST_KNOWN = 160 << 20
#: Words that are encoded at a time; a text is split at once up to so many characters. A longer word than this (in characters) is cut where no piece can lie across.
PART, AT_ONCE, LONG = 50_000, 1 << 20, 128


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    add_prefix: bool = True
    remove_extra_spaces: bool = True


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind = spec.get(3, UNIGRAM)
            if spec.get(24, 0):
                raise ValueError("models whose pieces end with the marker aren't supported")
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap, model.add_prefix, model.remove_extra_spaces = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
            if not spec.get(5, 1):
                raise ValueError("models that don't replace spaces by the marker aren't supported")
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Each way to make a piece of two others, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    ways = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                ways.append((-pieces[i][1], i, ids[left], ids[right], left, right))
    return [(w[4], w[5]) for w in sorted(ways)]


def build(model: PieceModel):
    """(tokenizer, words): the whole tokenizer, and one of the same model for words that are already normalised."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    fallback = any(kind == BYTE for _, _, kind in model.pieces)
    unknown = next(i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    if model.kind == BPE:
        inner = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=_merges(model.pieces), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=fallback)
    else:
        inner = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=fallback)
    tokenizer, words = Tokenizer(inner), Tokenizer(inner)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    tokenizer.normalizer = normalizers.Sequence([*steps, *([normalizers.Prepend(MARKER)] if model.add_prefix else []), normalizers.Replace(" ", MARKER)])
    if splits_at_marker(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*"), "isolated")
    tokenizer.decoder = words.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
    if user := [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER_DEFINED]:
        tokenizer.add_tokens(user)
    return tokenizer, words


def splits_at_marker(model: PieceModel) -> bool:
    return not any(MARKER in p.lstrip(MARKER) or kind == USER_DEFINED for p, _, kind in model.pieces)


class Codec:
    """Encodes and decodes with one model file; ``known`` has (ids, parity) by word."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer, self.words = build(self.model)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = splits_at_marker(self.model)
        self.plain = not self.model.charsmap and not self.model.remove_extra_spaces
        self.known: dict[str, tuple[bytes, bool]] = {}
        self.held = 0
        self.raw = np.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode() for p, _, kind in self.model.pieces] + [None], object)[:-1]
        self.word = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+") if self.by_word else re.compile("(?s).+")
        # Unknown characters without bytes to stand for them are joined, so there a text is never cut.
        self.cuts = self.by_word and any(kind == BYTE for _, _, kind in self.model.pieces)
        self.together = {p[i : i + 2] for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED) for i in range(len(p) - 1)}
        self.marker = self.processor.piece_to_id(MARKER)

    def pieces(self, normal: str):
        """The words of a normalised text; long ones in parts that no piece crosses, whose first character doesn't join a marker either."""
        for found in self.word.finditer(normal):
            start, stop = found.span()
            while self.cuts and stop - start > LONG:
                at = start + LONG // 2
                while at < stop and (normal[at - 1 : at + 1] in self.together or MARKER + normal[at] in self.together or normal[at] == MARKER):
                    at += 1
                yield normal[start:at]
                start = at
            if start < stop:
                yield normal[start:stop]

    def normalise(self, text: str) -> str:
        if not self.plain:
            return self.tokenizer.normalizer.normalize_str(text)
        return (MARKER if self.model.add_prefix and text else "") + text.replace(" ", MARKER)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def strung(self, ids: np.ndarray) -> bytes:
        """The bytes of a whole sequence, its prefix included."""
        return b"".join(self.raw[ids].tolist())

    def decode(self, ids: np.ndarray) -> str:
        """The text of a whole sequence; where its bytes aren't characters, the tokenizers library says what stands for them."""
        try:
            out = self.strung(ids).decode()
        except UnicodeDecodeError:
            out = self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return out.removeprefix(" ") if self.model.add_prefix else out

    def learn(self, new: list[str]) -> None:
        ids = [e.ids for e in self.words.encode_batch_fast(new, add_special_tokens=False)]
        prefix = 1 if self.model.add_prefix else 0
        theirs = self.processor.encode([w[prefix and w.startswith(MARKER) :].replace(MARKER, " ") for w in new], num_threads=2)
        for w, own, other in zip(new, ids, theirs, strict=True):
            # The library adds its prefix to a text only if it has characters, so a lone marker is looked up; a part of a long word doesn't have the prefix.
            if prefix and w == MARKER:
                other = [self.marker]
            elif prefix and not w.startswith(MARKER):
                other = other[1:] if other[:1] == [self.marker] else None
            self.known[w] = (struct.pack(f"<{len(own)}i", *own), own == other)
            self.held += 200 + 4 * len(w) + 4 * len(own)

    def parts(self, normal: str):
        """(words, their text) of a normalised text, in one part unless it is very long."""
        if len(normal) <= AT_ONCE:
            words = self.word.findall(normal)
            yield (list(self.pieces(normal)) if self.cuts and len(max(words, key=len, default="")) > LONG else words), normal
            return
        words, size = [], 0
        for w in self.pieces(normal):
            words.append(w)
            size += len(w)
            if size > AT_ONCE:
                yield words, "".join(words)
                words, size = [], 0
        yield words, "".join(words)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids as little-endian 32-bit integers, parity with sentencepiece, round trip) of each text. Words of several texts are encoded together."""
        out = [[[], True, True] for _ in texts]

        def finish(pending: list[tuple[int, list[str], str]]) -> None:
            if self.held > MOST_KNOWN:
                self.known.clear()
                self.held = 0
            new = list({w for _, words, _ in pending for w in words if w not in self.known})
            for i in range(0, len(new), PART):
                self.learn(new[i : i + PART])
            for i, words, text in pending:
                got = [self.known[w] for w in words]
                ids = b"".join([x[0] for x in got])
                out[i][0].append(ids)
                out[i][1] &= all([x[1] for x in got])
                out[i][2] &= self.strung(np.frombuffer(ids, "<i4")) == text.replace(MARKER, " ").encode()

        pending, size = [], 0
        for i, text in enumerate(texts):
            for words, part in self.parts(self.normalise(text)):
                pending.append((i, words, part))
                size += len(part)
                if size > min(2 * AT_ONCE, MOST_KNOWN // 8):
                    finish(pending)
                    pending, size = [], 0
        finish(pending)
        return [(b"".join(ids), parity, trip) for ids, parity, trip in out]


@lru_cache(2)
def codec(path: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    return Codec(path)


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, ids (little-endian 32-bit integers), n_ids, parity, round_trip.

    parity: the ids of every word equal those of the sentencepiece library; round_trip: the whole sequence of ids
    decodes to the normalised text. A null or empty text has no ids, both true. doc_id, null or repeated, is passed on; other columns are not read.
    """

    def run(rows: dict) -> dict:
        got = codec(path).encode_batch(rows["text"])
        return {"doc_id": rows["doc_id"], "ids": [x[0] for x in got], "n_ids": [len(x[0]) // 4 for x in got], "parity": [x[1] for x in got], "round_trip": [x[2] for x in got]}

    return map_texts(docs, run, f"doc_id {_kind(docs)}, ids binary, n_ids bigint, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids, more) to doc_id, text: the normalised text of the ids; null ids count as none."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = [np.frombuffer(x or b"", "<i4") for x in b.column("ids").to_pylist()]
            texts = list(map(codec(path).decode, ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(encoded)}, text string")
