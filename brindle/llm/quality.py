"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on the statistics of labelled rows give the rules: every path from a root to a node is a
conjunction of comparisons. A logistic regression with an L1 penalty gives them weights, most of
them zero. The rest become one Spark column expression, so that texts are scored by generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text that rules compare, as columns.

    An empty or null text is one empty word in one empty line: words, distinct_words and distinct_lines count these, all others are 0.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(text)
    words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    lines = F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    of = lambda pattern: F.regexp_count(text, F.lit(pattern))
    per = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
    return {
        "chars": F.log1p(chars.cast("double")),
        "words": F.log1p(n_words.cast("double")),
        "word_length": per(chars, n_words),
        "line_length": F.log1p(per(chars, n_lines)),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), n_lines),
        "upper": per(of(r"\p{Lu}"), chars),
        "digits": per(of(r"\p{Nd}"), chars),
        "symbols": per(of(r"[#$%&*@^~_=+<>{}\[\]\\/]"), chars),
        "bars": per(of(r"\|"), chars),
        "stops": per(of(r"[.:;]"), n_words),
        "bangs": per(of(r"[!?]"), n_words),
        "commas": per(of(","), n_words),
        "runs": per(of(r"([^\p{L}\p{N}\s])\1"), n_words),
        "long_words": per(of(r"[^\s]{20,}"), n_words),
        "other": per(of(r"[^\p{L}\p{N}\p{P}\p{S}\s]"), chars),
    }


@dataclass
class RuleModel:
    """names: of the statistics; rules: (weight, ((statistic, above?, threshold), ...))."""

    names: list[str]
    intercept: float = 0.0
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]] = field(default_factory=list)

    def column(self, of: dict[str, Column] | None = None) -> Column:
        """The score as an expression over columns of the statistics' names."""
        of = of or {n: F.col(n) for n in self.names}
        terms = [F.lit(float(self.intercept))]
        for weight, tests in self.rules:
            fits = None
            for name, above, at in tests:
                test = of[name] > F.lit(float(at)) if above else of[name] <= F.lit(float(at))
                fits = test if fits is None else fits & test
            terms.append(F.when(fits, F.lit(float(weight))).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # a balanced sum: deep ones overflow the analyser's stack
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grow_rules(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.3, least: int = 8, seed: int = 7) -> list[tuple[tuple[int, bool, float], ...]]:
    """The distinct paths of gradient-boosted trees for the logistic loss, each on half of the rows."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    score, rules = np.zeros(len(y)), {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, total_g, total_h = (1e-6, None), g[rows].sum(), h[rows].sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            c = code[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(c, v, len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k))
        return best[1]

    for _ in range(trees):
        p = _sigmoid(score)
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        half = rng.random(len(y)) < 0.5
        todo = [((), np.arange(len(y)))]
        while todo:
            path, rows = todo.pop()
            seen = rows[half[rows]]
            at = split(seen, g, h) if len(path) < depth and len(seen) >= 2 * least else None
            if path:
                rules.setdefault(tuple(sorted(path)))
            if at is None:
                score[rows] += rate * g[seen].sum() / (h[seen].sum() + 1)
                continue
            j, k = at
            low = code[rows, j] <= k
            for above, part in ((False, rows[low]), (True, rows[~low])):
                todo.append(((*path, (j, above, float(edges[j][k]))), part))
    return list(rules)


def _fires(x: np.ndarray, rules: list[tuple[tuple[int, bool, float], ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for r, tests in enumerate(rules):
        for j, above, at in tests:
            out[:, r] &= x[:, j] > at if above else x[:, j] <= at
    return out


def lasso(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression with an L1 penalty, by accelerated proximal gradient."""
    w = w / w.sum()
    beta, b = np.zeros(z.shape[1]), 0.0
    ahead, ahead_b, t = beta, b, 1.0
    v = np.full(z.shape[1], 1.0)
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        v = z.T @ (w * (z @ v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.25 * (float(v @ (z.T @ (w * (z @ v)))) + 1) * 1.1)
    for _ in range(steps):
        r = w * (_sigmoid(z @ ahead + ahead_b) - y)
        new = ahead - step * (z.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = ahead_b - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t2 * (new - beta), new_b + (t - 1) / t2 * (new_b - b)
        beta, b, t = new, new_b, t2
    return b, beta


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalties: tuple[float, ...] = (0.02, 0.01, 0.005, 0.0025, 0.001, 0.0005), balance: bool = False) -> RuleModel:
    """A sparse rule ensemble for labels 0 and 1; the largest penalty that does nearly best on a fifth of the rows.

    Without rows, or with one label only, the score is that label's smoothed share everywhere.
    """
    if len(y) < 20 or len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(names, float(np.log(share / (1 - share))))
    y = y.astype(float)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if balance else np.ones(len(y))
    rules = grow_rules(x, y, w)
    if not rules:
        share = y.mean()
        return RuleModel(names, float(np.log(share / (1 - share))))
    fires = _fires(x, rules)
    _, first = np.unique(np.packbits(fires, axis=0), axis=1, return_index=True)
    first = [i for i in sorted(first) if 0 < fires[:, i].sum() < len(y)]
    rules, fires = [rules[i] for i in first], fires[:, first]
    mean = fires.mean(axis=0)
    scale = np.sqrt(mean * (1 - mean))
    z = (fires - mean) / scale
    out = np.arange(len(y)) % 5 == 0
    loss = []
    for penalty in penalties:
        b, beta = lasso(z[~out], y[~out], w[~out], penalty)
        p = np.clip(_sigmoid(z[out] @ beta + b), 1e-9, 1 - 1e-9)
        loss.append(-(w[out] * (y[out] * np.log(p) + (1 - y[out]) * np.log(1 - p))).sum())
    # the sparsest model that does nearly as well as the best
    near = [p for p, x in zip(penalties, loss, strict=True) if x <= 1.1 * min(loss) + 0.004 * w[out].sum()]
    b, beta = lasso(z, y, w, max(near))
    kept = np.flatnonzero(np.abs(beta) > 1e-9)
    model = RuleModel(names, float(b - (beta / scale * mean).sum()))
    model.rules = [(float(beta[i] / scale[i]), tuple((names[j], above, at) for j, above, at in rules[i])) for i in kept]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels may not be learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 20_000) -> RuleModel:
    """The rule ensemble for labels 0 and 1, learnt from the statistics of the labelled texts.

    Held-out rows aren't looked at. At most about train_rows labels are fitted on: those with the
    smallest hash of their id, so that the rows sent to the driver are bounded.
    """
    known = labels.select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__label").isin(0, 1) & ~held_out(F.col("__label_id")) & F.col("__label_id").isNotNull())
    count = known.count()
    turn = F.pmod(F.xxhash64(F.col("__label_id"), F.lit("train")), F.lit(1_000_000))
    known = known.where(turn < F.lit(min(1_000_000, int(1_000_000 * train_rows / max(1, count)) + 1)))
    of = statistics(F.col("__text"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # the sample has a bound, so it may be sent to all executors
    sample = rows.join(F.broadcast(known), rows["__id"] == known["__label_id"]).select("__label_id", "__label", *(c.alias(n) for n, c in of.items()))
    table = sample.toPandas().sort_values(["__label_id", "__label", *of]).sample(frac=1.0, random_state=11)
    return fit_rules(table[list(of)].to_numpy(float), table["__label"].to_numpy(), list(of))


def with_score(docs: DataFrame, model: RuleModel, text_col: str = "text", to_filter: bool = False) -> DataFrame:
    """docs with the column __score.

    to_filter: the score is going to be filtered by. Then the statistics pass through a generator, as the filter would
    otherwise be pushed below them and compute them once for each rule.
    """
    of = statistics(F.col(text_col))
    names = {n: f"__stat_{n}" for n in of}
    staged = docs.withColumns({names[n]: c for n, c in of.items()})
    if to_filter:
        rest = [F.col(f"`{c}`") for c in docs.columns]
        staged = staged.select(*rest, F.inline(F.array(F.struct(*(F.col(c) for c in names.values())))))
    return staged.withColumn("__score", model.column({n: F.col(c) for n, c in names.items()})).drop(*names.values())


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 20_000) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted).

    score is from 0 to 1, higher where label 1 is likelier; predicted is 1 from 0.5 on. Learnt as
    in fit_quality, from the text alone.

    A null or empty text gets the score of its statistics, those of one empty word; texts count whole at any length. Rows
    without a label, and labels other than 0 and 1, are scored and not learnt from; a repeated row
    is returned each time, and each of an id's labels counts. Rows of a null id are scored. An
    empty table gives no rows; with no labels the score is 0.5. Columns of other names are ignored.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, train_rows)
    scored = with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier predicts as 1, with their columns.

    Null and empty texts, null ids, repeated rows and missing labels as in score_quality; an empty table stays empty.
    """
    model = fit_quality(docs, labels, **options)
    return with_score(docs, model, options.get("text_col", "text"), to_filter=True).where("__score >= 0.5").drop("__score")
