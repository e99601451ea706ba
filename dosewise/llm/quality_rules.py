"""Quality rules: counts of a whole text, and a linear-chain CRF that labels its lines as content or boilerplate.

Lines with a word are labelled; a line's features are shares of character kinds, word lengths and repetition. The CRF has a
weight per feature and label and a weight per pair of neighbouring labels. It is trained here by gradient ascent on the
likelihood from texts whose document label says good (all lines content) or bad (lines are boilerplate where the current
model finds them so, and at least the worst one: a few rounds of relabelling). Viterbi decoding gives the labels; a text is
kept if at least half of its words lie in content lines and no base rule rejects it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_rows, quoted, text_bytes

SYMBOLS = b"#*$%&|<>"  # fixed by the contract
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_CHARACTERS = _SPACE + bytes(range(0x80, 0xC0))  # white space and continuation bytes
_UPPER, _LOWER, _DIGIT = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x30, 0x3A))
#: Labelled documents that the training takes at most, half of each label as far as there are.
TRAIN_DOCS = 2000
#: Line feeds in the training documents together, half for each label, and in one of them. A longer document does not train.
TRAIN_LINES, TRAIN_DOC_LINES = 400_000, 20_000
CONTENT_SHARE = 0.5
FEATURES = ("one", "symbols", "exclamations", "upper", "digits", "bars", "repeated", "few_words", "long_words", "mid_symbols", "stutter")


@dataclass(frozen=True)
class Rules:
    """Base rules: fewest words, and the largest share (percent) of words in repeated 5-word windows."""

    min_words: int = 10
    max_repeat_percent: int = 20


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a ``width``-word window that occurs twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    # exact numbers of windows: the pair (number so far, next word) is numbered again for each further word
    numbers = ids[:n]
    for k in range(1, width):
        joined = numbers * len(seen) + ids[k : k + n]
        if k == width - 1 or len(seen) * n >= 1 << 62:
            numbers = joined
        else:
            numbers = np.unique(joined, return_inverse=True)[1]
    _, place, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[place] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.split()
    filled = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return (
        len(words),
        len(text.translate(None, _NOT_CHARACTERS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeated_words(words),
    )


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that have a word, and their numbers of words."""
    rows, sizes = [], []
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        upper, lower = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LOWER))
        symbols = size - len(line.translate(None, SYMBOLS))
        top = Counter(words).most_common(1)[0][1]
        rows.append(
            (
                1.0,
                min(1.0, symbols / n),
                min(1.0, line.count(b"!") / n),
                upper / (upper + lower + 1),
                min(1.0, 4.0 * (size - len(line.translate(None, _DIGIT))) / size),
                min(1.0, line.count(b"|") / n),
                (top - 1) / n if n > 4 else 0.0,
                1.0 if n < 4 else 0.0,
                1.0 if size / n > 20 else 0.0,
                1.0 if symbols / n > 0.3 else 0.0,
                sum(map(bytes.__eq__, words, words[1:])) / n,
            )
        )
        sizes.append(n)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


@dataclass
class Crf:
    """Scores of the labels 0 (content) and 1 (boilerplate): ``weights`` by feature and label, ``pairs`` by neighbours."""

    weights: np.ndarray
    pairs: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most likely labels of a chain; content wins ties."""
        scores = (features @ self.weights).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back = []
        a, b = scores[0] if scores else (0.0, 0.0)
        for s0, s1 in scores[1:]:
            from0, from1 = b + p10 > a + p00, b + p11 > a + p01
            back.append((from0, from1))
            a, b = (b + p10 if from0 else a + p00) + s0, (b + p11 if from1 else a + p01) + s1
        labels = np.zeros(len(scores), np.int64)
        at = int(b > a)
        for n in range(len(scores) - 1, -1, -1):
            labels[n] = at
            if n:
                at = int(back[n - 1][at])
        return labels


def _likelihood(weights: np.ndarray, pairs: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of padded chains (documents x lines), by forward and backward sums."""
    docs, length, _ = x.shape
    scores = x @ weights
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        after = scores[:, t + 1] + backward[:, t + 1]
        step = np.logaddexp(after[:, :1] + pairs[:, 0], after[:, 1:] + pairs[:, 1])
        backward[:, t] = np.where(mask[:, t + 1, None], step, backward[:, t + 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    chance = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
    truth = np.stack((1 - y, y), axis=2) * mask[..., None]
    d_weights = np.einsum("dtf,dtl->fl", x, truth - chance)
    d_pairs = np.zeros((2, 2))
    both = mask[:, 1:] & mask[:, :-1]
    for i in range(2):
        for j in range(2):
            joint = np.exp(forward[:, :-1, i] + pairs[i, j] + scores[:, 1:, j] + backward[:, 1:, j] - total[:, None]) * both
            seen = (truth[:, :-1, i] * truth[:, 1:, j] * both).sum()
            d_pairs[i, j] = seen - joint.sum()
    return d_weights, d_pairs


def fit(chains: list[np.ndarray], bad: list[bool], rounds: int = 4, steps: int = 60) -> Crf:
    """Train from line features per document and the documents' labels."""
    width = len(FEATURES)
    chains, bad = zip(*[(c, b) for c, b in zip(chains, bad, strict=True) if len(c)], strict=True) if any(map(len, chains)) else ((), ())
    if not chains or all(bad) or not any(bad):
        return Crf(np.zeros((width, 2)), np.zeros((2, 2)))  # nothing to tell apart: everything is content
    # chains of like length are padded together
    groups: dict[int, list[int]] = {}
    for n, chain in enumerate(chains):
        groups.setdefault((len(chain) - 1).bit_length(), []).append(n)
    batches = []
    for members in groups.values():
        length = max(len(chains[n]) for n in members)
        x, mask = np.zeros((len(members), length, width)), np.zeros((len(members), length), bool)
        for k, n in enumerate(members):
            x[k, : len(chains[n])], mask[k, : len(chains[n])] = chains[n], True
        is_bad = np.array([bad[n] for n in members])
        batches.append((x, mask, is_bad, np.where(is_bad[:, None], 1.0, 0.0) * mask))
    n_lines = sum(mask.sum() for _, mask, _, _ in batches)
    for turn in range(rounds):
        weights, pairs = np.zeros((width, 2)), np.zeros((2, 2))
        speed_w, speed_p = np.zeros_like(weights), np.zeros_like(pairs)
        for step in range(1, steps + 1):
            slopes = [_likelihood(weights, pairs, x, mask, y) for x, mask, _, y in batches]
            d_weights = sum(w for w, _ in slopes) / n_lines - 1e-4 * weights
            d_pairs = sum(p for _, p in slopes) / n_lines - 1e-3 * pairs
            speed_w, speed_p = 0.9 * speed_w + 0.1 * d_weights**2, 0.9 * speed_p + 0.1 * d_pairs**2
            rate = 0.3 / (1 + step / 20)
            weights = weights + rate * d_weights / (np.sqrt(speed_w) + 1e-6)
            pairs = pairs + rate * d_pairs / (np.sqrt(speed_p) + 1e-6)
        if turn + 1 == rounds:
            break
        for x, mask, is_bad, y in batches:
            margin = np.where(mask, x @ (weights[:, 1] - weights[:, 0]), -np.inf)
            own = (margin > 0).astype(float)
            own[np.arange(len(own)), margin.argmax(axis=1)] = 1.0
            y[is_bad] = own[is_bad]
    return Crf(weights, pairs)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """Fit on at most ``TRAIN_DOCS`` labelled documents of ``TRAIN_LINES`` lines together, chosen by a hash of their id: half of
    each label where there are enough. They enter the fit whole; one of more than ``TRAIN_DOC_LINES`` lines does not train. Rows
    that repeat an id, a text and a label count once; other texts and labels of an id are documents of their own, within the
    same bounds. Null ids, labels and texts are left out."""
    wanted = labels.where(F.col(quoted(label_col)).isin(0, 1)).select(F.col(quoted(id_col)).cast("string").alias("key"), F.col(quoted(label_col)).alias("label"))
    picked = None
    for label in (0, 1):
        own = wanted.where(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(TRAIN_DOCS // 2)
        picked = own if picked is None else picked.unionByName(own)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    measured = docs.select(
        F.col(quoted(id_col)).cast("string").alias("key"),
        text_bytes(text_col).alias("text"),
        F.sha2(text, 256).alias("digest"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))).alias("lines"),
    )
    rows = measured.join(picked.distinct(), "key")
    # a row of digests for each of these documents, in one order per label; at most TRAIN_DOCS rows reach the window
    short = rows.where(F.col("lines") <= TRAIN_DOC_LINES).select("key", "digest", "label", "lines").distinct()
    order = (F.xxhash64("key"), "key", "digest")
    so_far = F.sum("lines").over(Window.partitionBy("label").orderBy(*order))
    chosen = None
    for label in (0, 1):
        own = short.where(F.col("label") == label).orderBy(*order).limit(TRAIN_DOCS // 2)
        chosen = own if chosen is None else chosen.unionByName(own)
    fitting = materialise(chosen.withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_LINES // 2).select("key", "digest", "label"))
    rows = rows.join(fitting, ["key", "digest", "label"], "left_semi").dropDuplicates(["key", "digest", "label"])

    def make():
        def row(text, label):
            features = line_features(text)[0]
            return features.astype("<f8").tobytes(), int(label)

        return row

    found = map_rows(rows.select("text", "label"), "features binary, label int", make).collect()
    found.sort(key=lambda r: (r["label"], bytes(r["features"])))
    chains = [np.frombuffer(bytes(r["features"]), "<f8").reshape(-1, len(FEATURES)) for r in found]
    return fit(chains, [r["label"] == 0 for r in found])


RESULT = "doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Counts and verdict of every whole text, a row per row of ``docs``.

    A null text has no words and fails the base rules, as an empty one does. ``content_share`` is the share of words in
    lines labelled content (0 without words). Rows are independent: repeated rows and null keys give a row each.
    """

    def make():
        def row(key, text):
            n, chars, symbols, dup_lines, repeats = base_counts(text)
            failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
            share = 0.0
            if n:
                features, sizes = line_features(text)
                share = float(sizes[crf.viterbi(features) == 0].sum() / n)
            return key, n, chars, symbols, dup_lines, repeats, failed, share, not failed and share >= CONTENT_SHARE

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(quoted(id_col)).alias("doc_id"), text_bytes(text_col).alias("text")), RESULT.format(kind=kind), make)
