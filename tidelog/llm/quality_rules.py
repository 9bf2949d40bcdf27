"""Quality rules: counts of a text, and line labels by a linear-chain conditional random field.

Each line of a text is content or boilerplate; the labels of a text are the best path by Viterbi decoding. The share
of the text's characters in content lines decides whether it stays.

Only whole texts are labelled (kept or dropped), so the labels of the training lines are learned under that constraint:
at first all lines of a kept text are content and all lines of a dropped one boilerplate; then the field is trained, the
lines are relabelled by its best paths, and so on for a few rounds. A path that contradicts the label of its text, by a
content share below that which a kept text needs, or not below it in a dropped text, is not taken over. The first round
takes lines one by one, without transitions, as the labels don't change within a text yet. So the lines of a dropped
text that look like those of kept texts become content, and the field learns where labels change. A line that repeats
one before it in its text is boilerplate from the start. The field is trained in numpy by gradient ascent (Adam) on
the exact likelihood (forward and backward sums) of the whole lines of a bounded number of labelled texts.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_part, map_texts, text_of
from .shingles import mix

#: Fixed values.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
DIGITS, CAPITALS, MARKS = b"0123456789", bytes(range(65, 91)), b"!?;:=_~^@/\\\"'()[]{}-+"
RUN = 5
FEATURES = 13
#: Rounds of training and relabelling, and the number of steps in each.
ROUNDS, STEPS = 4, 40


def repeat_words(words: np.ndarray) -> int:
    """Of word numbers: how many words lie in runs of five that are found twice or more."""
    m = len(words) - RUN + 1
    if m < 2:
        return 0
    h = np.zeros(m, np.uint64)
    for i in range(RUN):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : m + i] + np.uint64(1))
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    if not len(starts):
        return 0
    covered = np.zeros(len(words), bool)
    for i in range(RUN):
        covered[starts + i] = True
    return int(covered.sum())


def base_counts(texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each text."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    out = []
    for text in texts:
        data = text.encode()
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        numbers = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
        out.append((len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(numbers)))
    return out


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, characters) of the lines with a word; white space doesn't count as characters."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.encode().split()
        if not words:
            continue
        data = b"".join(words)
        n, size = len(words), len(data)
        symbols = sum(map(line.count, SYMBOLS))
        last = data[-1:]
        rows.append((1.0, min(n, 50) / 50, float(n < 3), min(symbols / n, 2.0), float(symbols > 0), (size - len(data.translate(None, DIGITS))) / size, (size - len(data.translate(None, CAPITALS))) / size, min(size / n, 20) / 10, float(last in b".!?"), float(line in seen), float(n > 4 and not symbols), min((size - len(data.translate(None, MARKS))) / n, 2.0), 1 - len(set(words)) / n))
        seen.add(line)
        sizes.append(size)
    return np.array(rows, np.float64).reshape(len(rows), FEATURES), np.array(sizes, np.float64)


@dataclass(frozen=True)
class LineField:
    """Weights of the field: emission (2, features) and transition (2, 2); label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best labels of a text's lines."""
        if not len(features):
            return np.zeros(0, np.int8)
        scores = (features @ self.emission.T).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            from0, from1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1
        label = int(b >= a)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return np.array(path[::-1], np.int8)


def _batches(sequences: list[np.ndarray]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places, features padded to one length, which lines are real) of sequences of about equal length."""
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
    out, start = [], 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and len(sequences[order[stop]]) <= 1.25 * len(sequences[order[start]]) + 1:
            stop += 1
        places = order[start:stop]
        x = np.zeros((len(places), len(sequences[places[-1]]), FEATURES))
        real = np.zeros(x.shape[:2], bool)
        for row, i in enumerate(places):
            x[row, : len(sequences[i])], real[row, : len(sequences[i])] = sequences[i], True
        out.append((places, x, real))
        start = stop
    return out


def gradients(field: LineField, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, its gradients by emission and transition) of labels y of padded sequences; padding stands behind a sequence."""
    e = x @ field.emission.T
    n, length, _ = e.shape
    move, on = field.transition, real[:, :, None]
    fore, aft = np.zeros((length, n, 2)), np.zeros((length, n, 2))
    fore[0] = e[:, 0]
    for t in range(1, length):
        ahead = np.logaddexp(fore[t - 1][:, :1] + move[0], fore[t - 1][:, 1:] + move[1]) + e[:, t]
        fore[t] = np.where(on[:, t], ahead, fore[t - 1])
    for t in range(length - 2, -1, -1):
        behind = aft[t + 1] + e[:, t + 1]
        aft[t] = np.where(on[:, t + 1], np.logaddexp(move[:, 0] + behind[:, :1], move[:, 1] + behind[:, 1:]), 0.0)
    norm = np.logaddexp(fore[-1][:, 0], fore[-1][:, 1])
    node = np.exp(fore + aft - norm[None, :, None]).transpose(1, 0, 2)
    truth = np.eye(2)[y] * on
    by_emission = np.einsum("nlf,nlk->kf", x, truth - node * on)
    by_transition, score = np.zeros((2, 2)), float((truth * e).sum() - norm.sum())
    for t in range(1, length):
        both = truth[:, t - 1, :, None] * truth[:, t, None, :]
        pair = np.exp(fore[t - 1][:, :, None] + move + (e[:, t] + aft[t])[:, None, :] - norm[:, None, None])
        by_transition += ((both - pair) * on[:, t, None]).sum(axis=0)
        score += float((both * move).sum())
    return score, by_emission, by_transition


def train(sequences: list[np.ndarray], sizes: list[np.ndarray], kept: list[bool], least_content: float = 0.5, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """The field of texts given by the features and sizes of their lines; ``kept`` constrains the labels of a text's lines. Kept and dropped texts weigh the same altogether."""
    labels = [np.where(s[:, 9] > 0, 0, int(k)) if k else np.zeros(len(s), int) for s, k in zip(sequences, kept, strict=True)]
    field = LineField(np.zeros((2, FEATURES)), np.zeros((2, 2)))
    by_kind = [[i for i, k in enumerate(kept) if k == kind] for kind in (True, False)]
    batches = []
    for chosen in by_kind:
        share = 0.5 / max(sum(len(sequences[i]) for i in chosen), 1)
        batches += [([chosen[j] for j in places], x, real, share) for places, x, real in _batches([sequences[i] for i in chosen])]
    for k in range(ROUNDS):
        targets = []
        for places, x, *_ in batches:
            y = np.zeros(x.shape[:2], int)
            for row, i in enumerate(places):
                y[row, : len(labels[i])] = labels[i]
            targets.append(y)
        weights = np.concatenate((field.emission.ravel(), field.transition.ravel()))
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, STEPS + 1):
            grad = -decay * weights
            for (_, x, real, share), y in zip(batches, targets, strict=True):
                _, e, t = gradients(field, x, real, y)
                grad += share * np.concatenate((e.ravel(), t.ravel() if k else np.zeros(4)))
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            field = LineField(weights[: 2 * FEATURES].reshape(2, FEATURES), weights[2 * FEATURES :].reshape(2, 2))
        for i, (s, size) in enumerate(zip(sequences, sizes, strict=True)):
            if len(s):
                path = field.decode(s)
                if (float((size * path).sum()) >= least_content * size.sum()) == kept[i]:
                    labels[i] = np.where(s[:, 9] > 0, 0, path)
    return field


def fit(docs: DataFrame, labels: DataFrame, most_texts: int = 600) -> LineField | None:
    """The field of at most ``most_texts`` labelled texts, chosen by a hash of doc_id, all of their lines; None without texts of both labels. Texts that fail the base rules need no field and teach it nothing."""
    chosen = hashed_part(labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", "quality"), most_texts, "doc_id").orderBy(F.xxhash64("doc_id")).limit(most_texts)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(most_texts).collect()
    rows = [r for r, c in zip(rows, base_counts([r["text"] for r in rows]), strict=True) if not base_failed(c[0], c[4])]
    if len({r["quality"] for r in rows}) < 2:
        return None
    features, sizes = zip(*[line_features(r["text"]) for r in rows], strict=True)
    return train(list(features), list(sizes), [r["quality"] == 1 for r in rows])


def _judge(field: LineField | None, text: str, counts: tuple[int, ...], least_content: float) -> tuple[bool, bool, float, int, int]:
    """(base_failed, kept, content_share, n_content_lines, n_boilerplate_lines)."""
    failed = base_failed(counts[0], counts[4])
    features, sizes = line_features(text)
    path = field.decode(features) if field is not None else np.ones(len(sizes), np.int8)
    share = float((sizes * path).sum() / sizes.sum()) if len(sizes) else 0.0
    content = int(path.sum())
    return failed, not failed and share >= least_content, share, content, len(path) - content


def quality_rules(docs: DataFrame, field: LineField | None, least_content: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, n_content_lines, n_boilerplate_lines.

    kept is false if the base rules fail, else whether ``least_content`` of the characters lie in content lines. A
    null or empty text has no words and fails. Without a field (no labels to learn from) each line counts as content.
    doc_id, null or repeated, is passed on; other columns are not read.
    """

    def run(rows: dict) -> dict:
        counts = base_counts(rows["text"])
        judged = [_judge(field, t, c, least_content) for t, c in zip(rows["text"], counts, strict=True)]
        out = {"doc_id": rows["doc_id"]}
        for i, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
            out[c] = [x[i] for x in counts]
        for i, c in enumerate(("base_failed", "kept", "content_share", "n_content_lines", "n_boilerplate_lines")):
            out[c] = [x[i] for x in judged]
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_content_lines bigint, n_boilerplate_lines bigint")


def keep_quality(docs: DataFrame, field: LineField | None, least_content: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # so that few texts are in memory twice
                batch = whole.slice(start, 256)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                kept = [_judge(field, t, c, least_content)[1] for t, c in zip(texts, base_counts(texts), strict=True)]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
