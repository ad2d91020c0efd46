"""Quality rules: a linear-chain CRF labels lines as content or boilerplate.

Each line gets a few binned features (words, symbols, upper case, digits, end of
line, repetition).  A two-label chain is trained on a bounded sample of labelled
documents: lines of good documents are content, lines of bad ones boilerplate at
first; after a first fit, bad documents take the labels that the model decodes,
and the chain is fitted again.  Viterbi decoding labels the lines of every text;
the share of words in content lines decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.llm import bytearrays as B

LINE, WORD, RUN = B.RollingHash(31), B.RollingHash(32), B.RollingHash(33)
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, DIGIT, LETTER, BANG = (np.zeros(256, dtype=bool) for _ in range(4))
UPPER[65:91] = DIGIT[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = BANG[33] = True
END = np.zeros(256, dtype=bool)
END[list(b".!?:;\"'")] = True
#: Bins of each feature: a value's bin is the number of bounds that it reaches.
BOUNDS = {"words": (1, 3, 6, 16), "symbols": (0.02, 0.1, 0.5), "upper": (0.15, 0.5), "digits": (0.05, 0.3),
          "bangs": (0.05, 0.3), "length": (3.0, 5.0, 9.0), "end": (0.5,), "seen": (0.5,), "repeats": (0.3,), "start": (0.5,)}
N_FEATURES = sum(len(b) + 1 for b in BOUNDS.values())
BOILERPLATE, CONTENT = 0, 1


def _repeated(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: found twice or more in its group; found earlier in its group."""
    mixed = B.mix(keys ^ B.mix(group.astype(B.U64) + B.U64(1)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    twice, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, earlier


def measure(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts by document, feature codes by line, words by line, first line of each document (n + 1)."""
    n, size = len(offsets) - 1, len(data)
    s, e, firsts = B.words(data, offsets)
    doc_words = np.diff(firsts)
    owner = np.repeat(np.arange(n), doc_words)
    run = lambda mask: np.r_[0, np.cumsum(mask)]
    chars = run((data & 0xC0 != 0x80) & ~B.SPACE[data])
    symbols = run(SYMBOLS[data])
    # Words inside windows that occur twice or more in their text.
    hashes = WORD.of_bytes(data, s, e)
    wins = B.windows(hashes, window, RUN)
    at = np.flatnonzero(B.fits(firsts, window)[:len(wins)])
    twice, _ = _repeated(wins[at], owner[at])
    edge = np.zeros(len(s) + window + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    repeats = run(np.cumsum(edge)[:len(s)] > 0)
    # Lines: cut at \n and at document borders.
    breaks = np.flatnonzero(data == 10)
    ls = np.sort(np.r_[offsets[:-1], breaks + 1])
    le = np.sort(np.r_[breaks, offsets[1:]])
    first_line = np.r_[0, np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + 1)]
    line_doc = np.repeat(np.arange(n), np.diff(first_line))
    w0, w1 = np.searchsorted(s, ls), np.searchsorted(s, le)
    has = w1 > w0
    twice, seen = _repeated(LINE.of_bytes(data, ls, le)[has], line_doc[has])
    earlier = np.zeros(len(ls), dtype=bool)
    earlier[has] = seen
    words = w1 - w0
    part = lambda c, a, b: c[b] - c[a]
    doc = lambda c: part(c, offsets[:-1], offsets[1:]).astype(np.int64)
    base = {"n_words": doc_words.astype(np.int64), "word_chars": doc(chars), "n_symbols": doc(symbols),
            "n_dup_lines": part(run(earlier), first_line[:-1], first_line[1:]), "n_repeat_words": part(repeats, firsts[:-1], firsts[1:])}
    solid = np.maximum(part(chars, ls, le), 1)
    letters = np.maximum(part(run(LETTER[data]), ls, le), 1)
    some = np.maximum(words, 1)
    safe = np.r_[data, np.uint8(0)]
    last = np.where(has, e[np.maximum(w1 - 1, 0)] - 1 if len(e) else 0, size)
    head = np.where(has, s[np.minimum(w0, len(s) - 1)] if len(s) else 0, size)
    values = {"words": words, "symbols": part(symbols, ls, le) / solid, "upper": part(run(UPPER[data]), ls, le) / letters,
              "digits": part(run(DIGIT[data]), ls, le) / solid, "bangs": part(run(BANG[data]), ls, le) / some,
              "length": solid / some, "end": END[safe[last]], "seen": earlier, "repeats": part(repeats, w0, w1) / some,
              "start": UPPER[safe[head]] | (safe[head] >= 128)}
    codes, first = np.zeros((len(ls), len(BOUNDS)), dtype=np.int32), 0
    for k, (name, bounds) in enumerate(BOUNDS.items()):
        codes[:, k] = first + np.searchsorted(np.array(bounds, dtype=float), values[name].astype(float), side="right")
        first += len(bounds) + 1
    return base, codes, words, first_line


def _by_step(first: np.ndarray):
    """Documents by falling length, and for each step the lines of those still running."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    for t in range(int(length[0]) if len(length) else 0):
        yield begin[:int(np.searchsorted(-length, -t, side="left"))] + t


@dataclass
class ChainModel:
    weights: np.ndarray  # features x labels
    moves: np.ndarray    # from label x to label
    share: float = 0.5   # least share of words in content lines

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.weights[codes].sum(axis=1)

    def viterbi(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label of each line."""
        score = self.scores(codes)
        back = np.zeros((len(codes), 2), dtype=np.int8)
        steps = list(_by_step(first))
        for t, at in enumerate(steps):
            if t:
                way = score[at - 1][:, :, None] + self.moves[None]
                back[at] = way.argmax(axis=1)
                score[at] += way.max(axis=1)
        label = np.zeros(len(codes), dtype=np.int8)
        for t in range(len(steps) - 1, -1, -1):
            at, on = steps[t], len(steps[t + 1]) if t + 1 < len(steps) else 0
            label[at[on:]] = score[at[on:]].argmax(axis=1)
            if on:
                label[at[:on]] = back[at[:on] + 1, label[at[:on] + 1]]
        return label

    def gradient(self, codes: np.ndarray, first: np.ndarray, label: np.ndarray):
        """Gradient of the mean log-likelihood of the labelled lines."""
        score = self.scores(codes)
        steps = list(_by_step(first))
        fwd, bwd = score.copy(), np.zeros_like(score)
        for t, at in enumerate(steps[1:], 1):
            fwd[at] += np.logaddexp.reduce(fwd[at - 1][:, :, None] + self.moves[None], axis=1)
        for t in range(len(steps) - 2, -1, -1):
            nxt = steps[t + 1]
            bwd[nxt - 1] = np.logaddexp.reduce(self.moves[None] + (score[nxt] + bwd[nxt])[:, None, :], axis=2)
        total = np.logaddexp.reduce(fwd + bwd, axis=1)
        node = np.exp(fwd + bwd - total[:, None])
        gold = np.eye(2)[label]
        w = np.zeros_like(self.weights)
        np.add.at(w, codes, (gold - node)[:, None, :])
        m = np.zeros_like(self.moves)
        for at in steps[1:]:
            edge = np.exp(fwd[at - 1][:, :, None] + self.moves[None] + (score[at] + bwd[at])[:, None, :] - total[at][:, None, None])
            m -= edge.sum(axis=0)
            np.add.at(m, (label[at - 1], label[at]), 1.0)
        return w / len(codes), m / len(codes)

    def fit(self, codes, first, label, rounds: int = 120, rate: float = 2.0, decay: float = 1e-3) -> None:
        for _ in range(rounds):
            w, m = self.gradient(codes, first, label)
            self.weights += rate * (w - decay * self.weights)
            self.moves += rate * (m - decay * self.moves)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
          sample_rows: int = 600) -> ChainModel:
    """Fit the chain on all lines of at most ``sample_rows`` documents of each quality (least id hash).

    Rows with a null id, text or quality teach nothing.  Without samples of both
    qualities the model calls every line content.
    """
    marked = (labels.where(F.col(quality_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
              .agg(F.min(quality_col).cast("int").alias("quality")).where("id is not null"))
    some = [marked.where(F.col("quality") == q).orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(sample_rows) for q in (0, 1)]
    chosen = some[0].union(some[1]).select("id", "quality")
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body")).where("body is not null")
            .join(F.broadcast(chosen), "id"))  # at most 2 * sample_rows narrow rows

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.binary_block(batch.column("body"))
            quality, ids = batch.column("quality").to_pylist(), batch.column("id").to_pylist()
            for i, j in B.chunks(offsets):
                _, codes, _, first = measure(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                kept = [codes[a:b] for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_pydict({"id": pa.array([str(x) for x in ids[i:j]]), "quality": pa.array(quality[i:j], pa.int32()),
                                                  "codes": pa.array([x.ravel() for x in kept], pa.list_(pa.int32()))})

    got = sorted(rows.mapInArrow(lines, "id string, quality int, codes array<int>").collect(), key=lambda r: (r["id"], r["codes"]))
    model = ChainModel(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    if len({r["quality"] for r in got}) < 2:
        model.weights[:, CONTENT] = 1.0
        return model
    parts = [np.array(r["codes"], dtype=np.int32).reshape(-1, len(BOUNDS)) for r in got]
    codes, first = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    good = np.repeat([r["quality"] == 1 for r in got], np.diff(first))
    label = np.where(good, CONTENT, BOILERPLATE)
    model.fit(codes, first, label)
    label = np.where(good, CONTENT, model.viterbi(codes, first))
    model.fit(codes, first, label)
    return model


OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
       "content_share double, kept boolean, content_lines array<int>")


def assess(docs: DataFrame, model: ChainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, content_share, kept and the numbers of the content lines of every row.

    A null or empty text has no words: base_failed, not kept.  Lines without a
    word never count as repeated.  Ids may be null or repeated; rows are
    independent.  Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    fields = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.binary_block(batch.column("body"))
            for i, j in B.chunks(offsets):
                base, codes, words, first = measure(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                content = model.viterbi(codes, first) == CONTENT
                inside = np.r_[0, np.cumsum(words * content)]
                n = base["n_words"]
                share = (inside[first[1:]] - inside[first[:-1]]) / np.maximum(n, 1)
                failed = (n < 20) | (100 * base["n_repeat_words"] > 30 * n)
                at = np.flatnonzero(content)
                cuts = np.searchsorted(at, first)
                numbers = (at - np.repeat(first[:-1], np.diff(cuts))).astype(np.int32)
                cols = {**base, "base_failed": failed, "content_share": share, "kept": ~failed & (share >= model.share),
                        "content_lines": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(numbers))}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(cols[f]) if not isinstance(cols[f], pa.Array) else cols[f] for f in fields]],
                                                 names=["doc_id", *fields])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {OUT}")
