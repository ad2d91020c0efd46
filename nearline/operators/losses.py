"""In-batch similarity, softmax weights and losses as table aggregates.

Matrices are kept in long form ``(group, i, j, score)``.  Every pair is formed
inside a batch (or a step of ``world_size`` batches), whose size is fixed by
the caller, so the number of pairs is linear in the data.  Log-sum-exp always
subtracts the row maximum first, which keeps temperature 1e-4 finite.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearline.functions.vectors import dot, l2_normalize
from nearline.operators.indexing import with_row_key
from nearline.operators.search import whole
from nearline.session import materialize


def inbatch_similarity(members: DataFrame, query_members: DataFrame | None = None, normalize: bool = True,
                       batch: str = "batch_id", id_col: str = "doc_id", rep: str = "rep") -> DataFrame:
    """A1: all ordered pairs of a batch -> (batch_id, i, j, score).

    Rows come from ``query_members`` when given (first-half views retrieve the
    full passages), columns from ``members``; cosine when ``normalize``.
    """
    qm = members if query_members is None else query_members
    f = l2_normalize if normalize else (lambda c: F.col(c).cast("array<double>"))
    q = qm.select(F.col(batch).alias("batch_id"), F.col(id_col).alias("i"), f(rep).alias("_qv"))
    p = members.select(F.col(batch).alias("batch_id"), F.col(id_col).alias("j"), f(rep).alias("_pv"))
    return q.join(p, "batch_id").select("batch_id", "i", "j", dot("_qv", "_pv").alias("score"))


def softmax_weights(pairs: DataFrame, temperature: float, exclude_diagonal: bool = True,
                    group=("batch_id", "i"), col: str = "j", score: str = "score") -> DataFrame:
    """A2: row softmax of score / temperature; the diagonal (i == j) is removed first.

    A row whose only entry was the diagonal yields no output.
    """
    if temperature is None or temperature <= 0:
        raise ValueError(f"temperature must be above zero, got {temperature}")
    p = pairs.where(F.col(group[-1]) != F.col(col)) if exclude_diagonal else pairs
    w = Window.partitionBy(*group)
    z = F.col(score) / F.lit(float(temperature))
    p = p.withColumn("_z", z).withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return p.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_z", "_e")


def logsumexp_loss(scores: DataFrame, group=("batch_id", "qid"), cand: str = "pid", score: str = "score",
                   target: str = "target") -> DataFrame:
    """Per-row cross entropy: logsumexp(row) - score[target] -> (group..., loss).

    ``target`` is a column of ``scores``; a row without a target, or whose target
    is not among its candidates, raises instead of leaving the mean.
    """
    w = Window.partitionBy(*group)
    s = scores.withColumn("_m", F.max(score).over(w))
    agg = s.groupBy(*group).agg(
        (F.first("_m") + F.log(F.sum(F.exp(F.col(score) - F.col("_m"))))).alias("_lse"),
        F.max(F.when(F.col(cand) == F.col(target), F.col(score))).alias("_ts"))
    missing = F.raise_error(F.concat(F.lit("target not among the candidates of "),
                                     F.concat_ws("/", *[F.col(g).cast("string") for g in group])))
    return agg.select(*group, F.when(F.col("_ts").isNull(), missing.cast("double"))
                      .otherwise(F.col("_lse") - F.col("_ts")).alias("loss"))


def contrastive_loss(queries: DataFrame, passages: DataFrame, targets: DataFrame, scope: str = "batch",
                     world_size: int = 1, scale_loss: bool = False, scale_by_dim: bool = False,
                     dim: int | None = None, reduction: str = "none", batch: str = "batch_id") -> DataFrame:
    """A3/A4/A5: cross entropy of query-passage scores with one target passage per query.

    ``queries(batch_id, qid, rep)``, ``passages(batch_id, pid, rep)``,
    ``targets(qid, target)``, or ``targets(batch_id, qid, target)`` where a query
    has another target in each batch.  A query in several batches has a loss in
    each: the result is (batch_id, qid, loss).  ``scope='batch'`` scores a query
    against its own batch; ``'global'`` against the ``world_size`` batches of its step (the
    replicas gathered in one optimisation step).  ``scale_by_dim`` divides
    scores by ``dim`` (both sides times 1/sqrt(dim)); ``scale_loss`` multiplies
    by ``world_size``.
    """
    if scope == "batch":
        key_q, key_p = F.col(batch), F.col(batch)
    elif scope == "global":
        key_q = F.floor(F.col(batch) / world_size)
        key_p = F.floor(F.col(batch) / world_size)
    else:
        raise ValueError(f"unknown scope {scope!r}")
    keys = [batch, "qid"] if batch in targets.columns else ["qid"]
    q = (queries.join(targets.select(*keys, "target"), keys, "left")
         .select(key_q.alias("_g"), F.col(batch).alias("batch_id"), "qid", "target", F.col("rep").alias("_qv")))
    p = passages.select(key_p.alias("_g"), "pid", F.col("rep").alias("_pv"))
    s = q.join(p, "_g").select("batch_id", "qid", "target", "pid", dot("_qv", "_pv").alias("score"))
    if scale_by_dim:
        if not dim:
            raise ValueError("scale_by_dim needs dim")
        s = s.withColumn("score", F.col("score") / F.lit(float(dim)))
    loss = logsumexp_loss(s)
    if scale_loss:
        loss = loss.withColumn("loss", F.col("loss") * F.lit(float(world_size)))
    if reduction == "mean":
        return loss.agg(F.avg("loss").alias("loss"))
    return loss


def lm_loss(token_logp: DataFrame, by: str | None = "doc_id", ignore_label: int = -100) -> DataFrame:
    """Mean of -logp over tokens whose label is not ``ignore_label``; per ``by`` or global."""
    t = token_logp.where(F.col("label") != ignore_label)
    agg = [F.avg(-F.col("logp")).alias("lm_loss"), F.count(F.lit(1)).cast("bigint").alias("n_tokens")]
    return t.groupBy(by).agg(*agg) if by else t.agg(*agg)


def dual_loss(inbatch: DataFrame, seq: DataFrame | None, enabled: bool = True) -> DataFrame:
    """Mean in-batch loss (+ mean sequence loss when enabled), one row."""
    a = inbatch.agg(F.avg("loss").alias("inbatch_loss"))
    if not enabled or seq is None:
        return a.withColumn("total_loss", F.col("inbatch_loss"))
    b = seq.agg(F.avg("lm_loss").alias("seq_loss"))
    return a.select("inbatch_loss", b.select("seq_loss").scalar().alias("seq_loss")).withColumn(
        "total_loss", F.col("inbatch_loss") + F.col("seq_loss"))


def metric_log(log: DataFrame, every: int, step: str = "step", loss: str = "loss") -> DataFrame:
    """A10: mean loss per window of ``every`` steps."""
    return log.groupBy(F.floor(F.col(step) / every).cast("bigint").alias("window")).agg(
        F.min(step).alias("first_step"), F.max(step).alias("last_step"),
        F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- objectives and adapter gradients

def contrastive_objective(temperature: float = 1.0):
    """Cross entropy of a query's scores over the passages of its batch.

    An objective takes unit rows U (queries), V (passages) and the target row of
    each query; it returns the summed loss and its gradients by U and V.
    """
    if temperature <= 0:
        raise ValueError(f"temperature must be above zero, got {temperature}")

    def objective(U: np.ndarray, V: np.ndarray, target: np.ndarray):
        S_ = U @ V.T / temperature
        at = np.arange(len(target))
        m = S_.max(1, keepdims=True)
        E_ = np.exp(S_ - m)
        total = E_.sum(1, keepdims=True)
        loss = float((np.log(total[:, 0]) + m[:, 0] - S_[at, target]).sum())
        G = E_ / total
        G[at, target] -= 1.0
        G /= temperature
        return loss, G @ V, G.T @ U

    return objective


def margin_objective(margin: float = 0.2):
    """Hinge of every other passage of the batch that comes within ``margin`` of the target's score."""
    def objective(U: np.ndarray, V: np.ndarray, target: np.ndarray):
        S_ = U @ V.T
        at = np.arange(len(target))
        over = S_ - S_[at, target][:, None] + margin
        over[at, target] = 0.0
        G = (over > 0).astype(np.float64)
        G[at, target] = -G.sum(1)
        return float(np.maximum(over, 0.0).sum()), G @ V, G.T @ U

    return objective


def _adapter_rows(queries: DataFrame, passages: DataFrame, targets: DataFrame) -> DataFrame:
    """(batch_id, side, key, target, rep) of both sides, ids as strings; a query without a target raises."""
    keys = ["batch_id", "qid"] if "batch_id" in targets.columns else ["qid"]
    known = targets.select(*keys, F.col("target").cast("string").alias("target"))
    missing = F.raise_error(F.concat(F.lit("no target passage for query "), F.coalesce(F.col("qid").cast("string"), F.lit("null"))))
    q = queries.join(known, keys, "left").select(
        "batch_id", F.lit("q").alias("side"), F.col("qid").cast("string").alias("key"),
        F.when(F.col("target").isNull(), missing.cast("string")).otherwise(F.col("target")).alias("target"),
        F.col("rep").cast("array<double>").alias("rep"))
    p = passages.select("batch_id", F.lit("p").alias("side"), F.col("pid").cast("string").alias("key"),
                        F.lit(None).cast("string").alias("target"), F.col("rep").cast("array<double>").alias("rep"))
    return q.unionByName(p)


def _rows(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _unit(Z: np.ndarray):
    norm = np.maximum(np.linalg.norm(Z, axis=1, keepdims=True), 1e-12)
    return Z / norm, norm


def _target_rows(q: pd.DataFrame, p: pd.DataFrame) -> np.ndarray:
    """Row of each query's target in ``p``; one that is not in the batch raises."""
    at = pd.Index(p["key"])
    at = at.get_indexer(q["target"]) if at.is_unique else at.drop_duplicates().get_indexer(q["target"])
    if (at < 0).any():
        bad = q[at < 0].iloc[0]
        raise ValueError(f"target {bad['target']} of query {bad['key']} is not in batch {bad['batch_id']}")
    return at


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    q, p = (pdf[pdf["side"] == s].sort_values("key", kind="stable") for s in "qp")
    return q, p.drop_duplicates("key")


def _pull_back(U: np.ndarray, norm: np.ndarray, dU: np.ndarray) -> np.ndarray:
    """Gradient by the rows before they were scaled to unit length."""
    return (dU - U * (U * dU).sum(1, keepdims=True)) / norm


def _summed(parts: DataFrame, W: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean gradient and loss of rows (grad, loss, n): one job, d * d + 2 rows to the driver."""
    extra = F.array("loss", F.col("n").cast("double"))
    coef = parts.select(F.posexplode(F.concat("grad", extra)).alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
    g = np.zeros(W.size + 2)
    for r in coef.collect():
        g[r.i] = r.g
    n = max(g[-1], 1.0)
    return g[:-2].reshape(W.shape) / n, float(g[-2] / n)


PART = "grad array<double>, loss double, n bigint"


def adapter_gradient(queries: DataFrame, passages: DataFrame, targets: DataFrame, W: np.ndarray, objective=None):
    """Gradient by W and mean loss of ``objective`` on normalize(W x), in one phase: a batch is one group.

    ``targets`` has (qid, target) or (batch_id, qid, target); ids may have any
    type.  A query without a target, or with one outside of its batch, raises.
    A passage that repeats in a batch counts once.
    """
    objective = objective or contrastive_objective()

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = _sides(pdf)
        if not len(q):
            return pd.DataFrame({"grad": [np.zeros(W.size)], "loss": [0.0], "n": [0]})
        at = _target_rows(q, p)
        Xq, Xp = _rows(q["rep"]), _rows(p["rep"])
        (U, nq), (V, np_) = _unit(Xq @ W.T), _unit(Xp @ W.T)
        loss, dU, dV = objective(U, V, at)
        grad = _pull_back(U, nq, dU).T @ Xq + _pull_back(V, np_, dV).T @ Xp
        return pd.DataFrame({"grad": [grad.reshape(-1)], "loss": [loss], "n": [len(q)]})

    return _summed(_adapter_rows(queries, passages, targets).groupBy("batch_id").applyInPandas(per_batch, PART), W)


def cached_gradient(queries: DataFrame, passages: DataFrame, targets: DataFrame, W: np.ndarray, objective=None, chunk: int = 256):
    """The gradient of ``adapter_gradient`` in two phases, for batches whose inputs do not fit at once.

    First every row is represented without a gradient and the representations
    are stored; a batch then holds representations only, and the gradient of
    the objective by each of them is stored.  Second the inputs are read
    again in chunks of ``chunk`` rows, represented anew, and each chunk's stored
    gradients are carried back to W; a task returns one d x d sum.
    """
    objective = objective or contrastive_objective()
    rows = with_row_key(_adapter_rows(queries, passages, targets), "row")

    def represent(it):
        for pdf in it:
            for a in range(0, len(pdf), chunk):
                part = pdf.iloc[a:a + chunk]
                yield part.assign(rep=list(_unit(_rows(part["rep"]) @ W.T)[0]))

    reps = materialize(rows.mapInPandas(represent, rows.schema), "representations")

    def by_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = _sides(pdf)
        if not len(q):
            return pd.DataFrame({"row": p["row"], "by": [np.zeros(W.shape[0])] * len(p), "loss": 0.0, "n": 0})
        loss, dU, dV = objective(_rows(q["rep"]), _rows(p["rep"]), _target_rows(q, p))
        size = len(q) + len(p)
        return pd.DataFrame({"row": [*q["row"], *p["row"]], "by": [*dU, *dV], "loss": [loss] + [0.0] * (size - 1),
                             "n": [len(q)] + [0] * (size - 1)})

    grads = materialize(reps.groupBy("batch_id").applyInPandas(by_batch, "row bigint, by array<double>, loss double, n bigint"),
                        "representation-gradients")

    def replay(it):
        grad, loss, n = np.zeros(W.shape), 0.0, 0
        for pdf in it:
            for a in range(0, len(pdf), chunk):
                part = pdf.iloc[a:a + chunk]
                X = _rows(part["rep"])
                U, norm = _unit(X @ W.T)
                grad += _pull_back(U, norm, _rows(part["by"])).T @ X
                loss, n = loss + float(part["loss"].sum()), n + int(part["n"].sum())
        yield pd.DataFrame({"grad": [grad.reshape(-1)], "loss": [loss], "n": [n]})

    return _summed(rows.select("row", "rep").join(grads, "row").select("rep", "by", "loss", "n").mapInPandas(replay, PART), W)


def fit_linear_adapter(queries: DataFrame, passages: DataFrame, targets: DataFrame, dim: int, steps: int = 5,
                       lr: float = 0.1, seed: int = 42, objective=None, gradient=None):
    """Learn W (d x d) minimising ``objective`` (default: in-batch contrastive) of normalize(W x).

    Gradient descent; a step is one call of ``gradient`` (``adapter_gradient`` or
    ``cached_gradient``); the driver holds only W.  Returns (W, [loss per step]).
    """
    gradient = gradient or adapter_gradient
    rng = np.random.default_rng(seed)
    W = np.eye(dim) + 0.01 * rng.standard_normal((dim, dim))
    losses = []
    for _ in range(steps):
        g, loss = gradient(queries, passages, targets, W, objective)
        losses.append(loss)
        W = W - lr * g
    return W, losses


#: Documents times terms of a batch that a task holds at once.
BATCH_CELLS = 1 << 22


def _by_term(code: np.ndarray, doc: np.ndarray, docs: int, terms: int):
    """(tokens, term counts (docs, terms) by a selection of tokens) of one range of terms after another."""
    order = np.argsort(code, kind="stable")
    wide = max(1, BATCH_CELLS // max(1, docs))
    for lo in range(0, terms, wide):
        hi = min(terms, lo + wide)
        at = order[slice(*np.searchsorted(code[order], [lo, hi]))]
        count = lambda some, lo=lo, n=hi - lo: np.bincount(doc[some] * n + code[some] - lo, minlength=docs * n).reshape(docs, n).astype(np.float64)
        yield lo, at, count


def _batch_mixture(temperature: float, ratio: float):
    """Kernel over the documents (batch_id, doc_id, w) of a batch: its second-half terms with the other documents' mixture.

    Rows of one id count as one document.  A document without another in its batch, or without an id, has no mixture.
    """
    def run(t: pa.Table) -> pa.Table:
        ids, words_of = whole(t.column("doc_id")).dictionary_encode(), whole(t.column("w"))
        doc = pc.fill_null(ids.indices, len(ids.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        docs, known = len(ids.dictionary) + 1, len(ids.dictionary)
        n = pc.fill_null(words_of.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words_of.flatten().dictionary_encode()
        code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        late, of = pos >= np.floor(n * ratio)[row], doc[row]
        times = np.bincount(doc, minlength=docs).astype(np.float64)  # rows of the id
        overlap, q_sq, d_sq = np.zeros((docs, docs)), np.zeros(docs), np.zeros(docs)
        for _, at, count in _by_term(code, of, docs, terms):
            Q, D = count(at[~late[at]]), count(at)
            overlap += Q @ D.T
            q_sq, d_sq = q_sq + (Q * Q).sum(1), d_sq + (D * D).sum(1)
        Z = overlap / (np.maximum(np.sqrt(q_sq), 1e-12)[:, None] * np.maximum(np.sqrt(d_sq), 1e-12)) / temperature
        pairs = ~np.eye(docs, dtype=bool)
        pairs[known], pairs[:, known] = False, False
        if t.num_rows and t.column("batch_id")[0].as_py() is None:
            pairs[:] = False
        paired = pairs.any(1)
        Z[~pairs] = -np.inf
        top = np.where(paired, Z.max(1, initial=-np.inf), 0.0)
        E = np.exp(Z - top[:, None]) * times
        weight = E / np.where(paired, E.sum(1), 1.0)[:, None]
        length = np.ones(docs)
        some = np.flatnonzero(n)[::-1]
        length[doc[some]] = n[some]  # the first row of an id that has words
        mix = np.zeros(len(row))
        for lo, at, count in _by_term(code, of, docs, terms):
            M = weight @ (count(at) / length[:, None])
            mix[at] = M[of[at], code[at] - lo]
        of, pos, code, mix = of[late], pos[late], code[late], mix[late]
        if (times[:known] > 1).any():  # rows of one id add up by position
            _, same = np.unique(np.stack([of, pos]), axis=1, return_inverse=True)
            mix = np.bincount(same.ravel(), weights=mix)[same.ravel()]
        order = np.lexsort((mix, code, of))
        new = np.flatnonzero(np.r_[True, np.any([np.diff(x[order]) != 0 for x in (of, code, mix)], axis=0)]) if len(order) else order
        first = order[new]
        return pa.table({"batch_id": whole(t.column("batch_id")).take(pa.array(np.zeros(len(first), dtype=np.int64))),
                         "doc_id": ids.dictionary.take(pa.array(of[first], mask=of[first] == known)),
                         "term": coded.dictionary.take(pa.array(code[first])),
                         "n": pa.array(np.diff(np.r_[new, len(order)]).astype(np.int64)),
                         "mix": pa.array(mix[first]), "paired": pa.array(paired[of[first]])})

    return run


def retrieval_weighted_lm_loss(members: DataFrame, corpus: DataFrame, lam: float = 0.1, temperature: float = 0.05,
                               ratio: float = 0.5, text_col: str = "text", corpus_text: str = "text") -> DataFrame:
    """The training objective re-aimed to a count language model.

    For document i of a batch: loss_i = -mean over its second-half tokens t of
    ln(lam * p_bg(t) + (1 - lam) * sum_j w_ij * p_j(t)), where p_j is document
    j's unigram distribution, p_bg the corpus unigram distribution, and w_ij the
    softmax (temperature, diagonal excluded) of the cosine between i's first-half
    term counts and j's full term counts.  A document alone in its batch uses
    lam = 1.  A batch meets in one task, as its size is fixed by the caller; what leaves the
    task is a row for each distinct second-half term of a document, which is joined to
    the corpus distribution.  -> (batch_id, doc_id, loss)
    """
    from nearline.functions.text import words

    if temperature is None or temperature <= 0:
        raise ValueError(f"temperature must be above zero, got {temperature}")
    kind = {c: members.schema[c].dataType.simpleString() for c in ("batch_id", "doc_id")}
    # Texts are exchanged, and cut into words where they arrive.
    toks = members.select("batch_id", "doc_id", F.col(text_col).alias("_text")).repartition("batch_id")
    toks = toks.select("batch_id", "doc_id", words(F.col("_text")).alias("w"))
    second = toks.groupBy("batch_id").applyInArrow(
        _batch_mixture(float(temperature), float(ratio)),
        f"batch_id {kind['batch_id']}, doc_id {kind['doc_id']}, term string, n bigint, mix double, paired boolean")
    counts = corpus.select(F.explode(words(F.col(corpus_text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts, "a8_terms")
    bg = counts.select("term", (F.col("c") / counts.agg(F.sum("c").alias("N")).select("N").scalar()).alias("pbg"))
    lam_i = F.when(F.col("paired"), F.lit(float(lam))).otherwise(F.lit(1.0))
    p = lam_i * F.col("pbg") + (1.0 - lam_i) * F.col("mix")
    return (second.join(bg, "term").groupBy("batch_id", "doc_id")
            .agg((-F.sum(F.col("n") * F.log(p)) / F.sum("n")).alias("loss")))
