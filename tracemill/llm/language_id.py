"""Language identification with interpolated Kneser-Ney models of characters.

One model a language, of the same order, over lower-cased letters with runs of anything else as one
blank. The models of all languages are stored together: for every context length one sorted array
of 64-bit hashes, and beside it a column of log probabilities for each language (of what follows)
or of log back-off weights (of contexts). A text is scored in one pass of binary searches; the
language of the lowest cross-entropy per character wins. A text is rejected where that entropy lies beyond a limit that
calibration sets for each language, between the entropies of its own rows that were not fitted on and those of the rows' letters
in random order. Rows in two languages and rows with codes in them stay, and a
language that is close kin to a learned one is taken for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm._io import small_batches, turn_to

UNKNOWN = "und"
#: Symbols that are scored at once, whatever a text's length.
SLICE = 1 << 20
#: Languages that are learned at most; beyond, training is an error.
MOST_LANGUAGES = 2000
_P = np.uint64(0x9E3779B97F4A7C15)
_BLANK = 32
_fold_cache: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> lower-cased letter, or a blank."""
    global _fold_cache
    if _fold_cache is None:
        out = np.full(0x110000, _BLANK, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold_cache = out
    return _fold_cache


def symbols(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, where each text starts, with its end at last; letters of each text).

    Each text begins with order - 1 starting marks and a blank; runs of blanks are one.
    """
    lead = "\x01" * (order - 1) + " "
    joined = np.frombuffer("".join([x for t in texts for x in (lead, t or "")]).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _fold_table()[joined]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([order + len(t or "") for t in texts], out=starts[1:])
    blank = folded == _BLANK
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    marks = (starts[:-1, None] + np.arange(order)).ravel()
    keep[marks] = True
    folded[(starts[:-1, None] + np.arange(order - 1)).ravel()] = 1
    at = np.r_[0, np.cumsum(keep)]
    letters = np.r_[0, np.cumsum(~blank)]
    return folded[keep].astype(np.uint64), at[starts], letters[starts[1:]] - letters[starts[:-1]]


def gram_sums(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order, what identifies the n symbols that end at each place."""
    out = [sym.copy()]
    for n in range(2, order + 1):
        h = out[-1].copy()
        h[n - 1 :] += sym[: len(sym) - n + 1] * np.uint64(pow(int(_P), n - 1, 1 << 64))
        out.append(h)
    return out


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits are even, for the directory of a sorted array."""
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


class SortedHashes:
    """A sorted array of 64-bit hashes with a directory of where each leading bit pattern starts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, min(20, int(np.log2(max(1, len(keys)))) + 1)))
        heads = (keys >> self.shift).astype(np.int64)
        size = 1 << (64 - int(self.shift))
        self.first = np.searchsorted(heads, np.arange(size + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is not there."""
        head = (h >> self.shift).astype(np.int64)
        place = np.full(len(h), -1, np.int32)
        if not self.deep:
            return place
        at = self.first[head]
        last = len(self.keys) - 1
        todo: np.ndarray | None = None
        for _ in range(self.deep):
            got = self.keys[np.minimum(at, last)]
            want = h if todo is None else h[todo]
            hit = got == want
            if todo is None:
                place[hit] = at[hit]
                todo = np.flatnonzero(got < want)
            else:
                place[todo[hit]] = at[hit]
                more = got < want
                todo, at = todo[more], at[more]
                at = at + 1
                if not len(todo):
                    break
                continue
            at = at[todo] + 1
        return place


@dataclass
class KneserNey:
    """languages; keys[n-1]: sorted hashes of n-grams, logp[n-1]: (n-grams x languages);
    contexts[n-1]: sorted hashes of contexts of n symbols, back[n-1]: log back-off weights;
    base: log probability of a symbol never seen; cross, slack: limits of rejection, and what n scored symbols add to them as
    slack / sqrt(n); scale: of the score."""

    order: int
    languages: list[str]
    keys: list[SortedHashes] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[SortedHashes] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cross: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slack: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0

    def log_probs(self, sym: np.ndarray) -> np.ndarray:
        """(languages x symbols) log probability of each symbol after those before it."""
        out = np.zeros((len(self.languages), len(sym)), np.float32)
        sums = gram_sums(sym, self.order)
        todo: np.ndarray | None = None
        for n in range(self.order, 0, -1):
            at = self.keys[n - 1].find(spread(sums[n - 1] if todo is None else sums[n - 1][todo]))
            if todo is None:
                for k in range(len(self.languages)):
                    np.take(self.logp[n - 1][k], at, out=out[k], mode="clip")
                todo = np.flatnonzero(at < 0)
                out[:, todo] = 0
            else:
                hit = at >= 0
                for k in range(len(self.languages)):
                    out[k, todo[hit]] += self.logp[n - 1][k][at[hit]]
                todo = todo[~hit]
            if not len(todo):
                return out
            if n > 1:
                # context: the n - 1 symbols before; its weight moves the rest to the shorter gram
                at = self.contexts[n - 2].find(spread(sums[n - 2][np.maximum(todo - 1, 0)]))
                hit = at >= 0
                for k in range(len(self.languages)):
                    out[k, todo[hit]] += self.back[n - 2][k][at[hit]]
        for k in range(len(self.languages)):
            out[k, todo] += np.float32(self.base[k])
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropy in nats a symbol, symbols scored, letters."""
        sym, starts, letters = symbols(texts, self.order)
        n = np.diff(starts) - self.order
        sums = np.zeros((len(self.languages), len(texts)))
        text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
        scored = np.ones(len(sym), bool)
        scored[(starts[:-1, None] + np.arange(self.order)).ravel()] = False  # what leads each text is not scored
        for at in range(0, len(sym), SLICE):
            lead = min(at, self.order - 1)
            logp = self.log_probs(sym[at - lead : at + SLICE])[:, lead:]
            use = scored[at : at + SLICE]
            own = text_of[at : at + SLICE][use]
            for k in range(len(self.languages)):
                sums[k] += np.bincount(own, logp[k][use], len(texts))
        return (-sums / np.maximum(n, 1)).T, n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, accepted) of each text.

        Score: the winner's share of exp(-scale * sqrt(n) * entropy), fitted on calibration rows.
        """
        h, n, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        gap = (h - h.min(axis=1, keepdims=True)) * (self.scale * np.sqrt(np.maximum(n, 1)))[:, None]
        score = 1.0 / np.exp(-gap).sum(axis=1)
        low = h[np.arange(len(h)), best]
        has = letters > 0
        accepted = has & (low <= self.cross[best] + self.slack[best] / np.sqrt(np.maximum(n, 1)))
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, has)]
        return names, np.where(has, score, 0.0), np.where(has, low, 0.0), accepted


def _counts(sums: list[np.ndarray], scored: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams that end in a scored symbol: hash, hash of the context, hash of the n-gram less its first symbol, count."""
    keys, first, counts = np.unique(spread(sums[n - 1][scored]), return_index=True, return_counts=True)
    at = scored[first]
    none = np.zeros(len(at), np.uint64)
    return keys, spread(sums[n - 2][at - 1]) if n > 1 else none, spread(sums[n - 2][at]) if n > 1 else none, counts


def _prepared(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    sym, starts, _ = symbols(texts, order)
    lead = np.zeros(len(sym), bool)
    lead[(starts[:-1, None] + np.arange(order)).ravel()] = True
    return gram_sums(sym, order), np.flatnonzero(~lead)


def _one_language(texts: list[str], order: int) -> tuple[list, list, float]:
    """Interpolated Kneser-Ney of one language: [(keys, p)] and [(contexts, weight)] by order, and the base."""
    sums, scored = _prepared(texts, order)
    grams = [_counts(sums, scored, n) for n in range(1, order + 1)]
    seen = max(2, len(grams[0][0]))
    base = 1.0 / (4 * seen + 1000)  # each symbol never seen; a tenth of a part at most goes there
    probs: list[tuple[np.ndarray, np.ndarray]] = []
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(1, order + 1):
        keys, context, lower, counts = grams[n - 1]
        if n < order:  # continuation counts: how many symbols stand before
            _, _, low_of, _ = grams[n]
            got, times = np.unique(low_of, return_counts=True)
            at = np.searchsorted(got, keys)
            at[at == len(got)] = 0
            c = np.where(got[at] == keys, times[at], 1).astype(float) if len(got) else np.ones(len(keys))
        else:
            c = counts.astype(float)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx, inv = np.unique(context, return_inverse=True)
        total = np.bincount(inv, c, len(ctx))
        kinds = np.bincount(inv, minlength=len(ctx))
        weight = d * kinds / total
        if n == 1:
            under = np.full(len(keys), 1.0 / seen)
            p = (np.maximum(c - d, 0) / total[inv] + weight[inv] * under) * 0.999
        else:
            at = np.searchsorted(probs[-1][0], lower)
            p = np.maximum(c - d, 0) / total[inv] + weight[inv] * probs[-1][1][at]
            weights.append((ctx, weight))
        probs.append((keys, p))
    return probs, weights, base


def fit(rows: list[tuple[str, str]], order: int = 4, calibrate: float = 0.2, quantile: float = 0.999) -> KneserNey:
    """A model of (text, language) rows; every fifth of a language's rows calibrates and is not counted.

    Rejection: half-way from the ``quantile`` of the calibration rows' entropies to the lowest hundredth of those of
    noise, with a slack for short texts by pieces of the calibration rows. The score's scale is fitted to the calibration
    rows' log likelihood. Without rows the model has no language and knows nothing.
    """
    languages = sorted({lang for _, lang in rows})
    model = KneserNey(order, languages)
    held: list[tuple[str, str]] = []
    trained: list[tuple[str, str]] = []
    each = []
    for lang in languages:
        own = [t for t, x in rows if x == lang]
        step = max(2, round(1 / calibrate))
        train = [t for i, t in enumerate(own) if i % step or len(own) < step]
        trained += [(t, lang) for t in train]
        held += [(t, lang) for i, t in enumerate(own) if not i % step]
        each.append(_one_language(train, order))
    none = np.zeros(0, np.uint64)
    model.keys = [SortedHashes(np.unique(np.concatenate([none, *(e[0][n][0] for e in each)]))) for n in range(order)]
    model.contexts = [SortedHashes(np.unique(np.concatenate([none, *(e[1][n][0] for e in each)]))) for n in range(order - 1)]
    model.base = np.log(np.array([e[2] for e in each]))
    model.back = [np.zeros((len(languages), len(c.keys)), np.float32) for c in model.contexts]
    for k, (_, weights, _) in enumerate(each):
        for n, (ctx, w) in enumerate(weights):
            model.back[n][k, model.contexts[n].find(ctx)] = np.log(np.maximum(w, 1e-9))
    model.logp = [np.zeros((len(languages), len(key.keys)), np.float32) for key in model.keys]
    # an n-gram that one language lacks gets the value that backing off gives it there
    lower_of = _union_lower(trained, order, model)
    for k, (probs, _, base) in enumerate(each):
        for n in range(order):
            out = model.logp[n][k]
            if n == 0:
                out[:] = np.log(base)
            else:
                low, ctx = lower_of[n]
                at = model.contexts[n - 1].find(ctx)
                out[:] = model.logp[n - 1][k][low] + np.where(at >= 0, model.back[n - 1][k][at], 0)
            out[model.keys[n].find(probs[n][0])] = np.log(probs[n][1])
    _calibrate(model, held, quantile)
    return model


def _union_lower(rows: list[tuple[str, str]], order: int, model: KneserNey) -> list:
    """For every stored n-gram: the place of the shorter gram among the stored, and its context's hash."""
    sums, scored = _prepared([t for t, _ in rows], order)
    out: list = [None]
    for n in range(2, order + 1):
        keys, context, lower, _ = _counts(sums, scored, n)
        at = np.searchsorted(keys, model.keys[n - 1].keys)
        out.append((np.searchsorted(model.keys[n - 2].keys, lower[at]), context[at]))
    return out


def noise(text: str, seed: int) -> str:
    """A text's characters in random order."""
    return "".join(np.random.default_rng(seed).permutation(list(text)).tolist())


def _calibrate(model: KneserNey, held: list[tuple[str, str]], quantile: float) -> None:
    model.cross, model.slack = np.full(len(model.languages), np.inf), np.zeros(len(model.languages))
    if not held:
        return
    h, n, letters = model.entropies([t for t, _ in held])
    truth = np.array([model.languages.index(x) for _, x in held])
    ok = letters > 0
    odd, odd_n, _ = model.entropies([noise(t, i) for i, (t, _) in enumerate(held)])
    odd = odd[odd_n >= 50].min(axis=1)
    long = ok & (n >= 50)
    # short texts: the first 20, 60 and 200 characters of the rows
    shorts = [(t[:m], k) for (t, _), k in zip(held, truth) for m in (20, 60, 200)]
    sh, sn, sl = model.entropies([t for t, _ in shorts])
    sk = np.array([k for _, k in shorts])
    for k in range(len(model.languages)):
        own = h[long & (truth == k), k] if (long & (truth == k)).any() else h[ok & (truth == k), k]
        if not len(own):
            continue
        high = np.quantile(own, quantile)
        low = max(high, np.quantile(odd, 0.01)) if len(odd) else 2 * high
        model.cross[k] = (high + low) / 2
        mine = (sk == k) & (sl > 0)
        if mine.any():
            model.slack[k] = max(0.0, np.quantile((sh[mine, k] - model.cross[k]) * np.sqrt(np.maximum(sn[mine], 1)), quantile))
    best, most = 1.0, -np.inf
    for scale in np.geomspace(0.05, 200, 60):
        z = -h[ok] * (scale * np.sqrt(np.maximum(n[ok], 1)))[:, None]
        z -= z.max(axis=1, keepdims=True)
        fit_ = (z[np.arange(len(z)), truth[ok]] - np.log(np.exp(z).sum(axis=1))).mean()
        if fit_ > most:
            best, most = float(scale), fit_
    model.scale = best


def in_fold(id_col: str, folds: int = 5) -> Column:
    """True for held-out rows: crc32 of the id as text leaves no remainder. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_chars: int = 600_000, order: int = 4) -> KneserNey:
    """Fit on labelled rows outside the held-out fold.

    The sample is bounded: of each language whole texts of about ``most_chars`` characters in all, those of the least hashes of
    their ids; all, if they have fewer. More than ``MOST_LANGUAGES`` languages are an error.
    """
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~in_fold(id_col))
    sizes = labelled.groupBy(F.col(lang_col).alias("l")).agg(F.sum(F.length(text_col).cast("double")).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return fit([], order)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, most_chars / max(1.0, r["n"])))])[F.col(lang_col)]
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.filter(unit < share).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.col(id_col).cast("long").alias("i")).collect()
    return fit([(r["t"], r["l"]) for r in sorted(rows, key=lambda r: (r["l"], r["i"] is None, r["i"] or 0, r["t"]))], order)


OUT = "id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean"


def identify(df: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Language of each whole text: id, held_out, lang_pred, score, cross_entropy, accepted.

    ``keep``: columns of ``df`` to return in place of id and held_out (the result's columns come
    after, with a leading ``_``; columns of ``df`` that have such names keep their values). A null text or one without letters
    is ``und`` with score 0 and is not accepted. Equal texts, repeated rows among them, get equal results. A very long text is
    scored in slices of symbols, which changes nothing. Empty tables give empty results.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("language_id")
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, score, cross, ok = [], [], [], []
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") < 1_000_000):
                    chars += len(texts[to] or "")
                    to += 1
                if model.languages:
                    got = model.predict(texts[at:to])
                else:
                    got = ([UNKNOWN] * (to - at), np.zeros(to - at), np.zeros(to - at), np.zeros(to - at, bool))
                names += got[0]
                score.append(got[1])
                cross.append(got[2])
                ok.append(got[3])
                at = to
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            head = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*head, pa.array(names, pa.string()), cat(score, pa.float64()), cat(cross, pa.float64()), cat(ok, pa.bool_())], names=out_names)

    if keep is None:
        rows = df.select(F.col(id_col).cast("long").alias("id"), in_fold(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
        schema = OUT
    else:
        rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
        kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_lang_pred string", "_score double", "_cross_entropy double", "_accepted boolean"])
    out_names = rows.columns[:-1] + ["lang_pred", "score", "cross_entropy", "accepted"]
    if keep is not None:
        out_names = rows.columns[:-1] + ["_lang_pred", "_score", "_cross_entropy", "_accepted"]
    return rows.mapInArrow(run, schema)
