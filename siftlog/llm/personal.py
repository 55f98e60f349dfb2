"""Personal data in texts: base patterns, and a character tagger that adds what they miss.

The tagger is a bidirectional LSTM over characters with CRF transitions between tags, written in numpy
and trained from labelled spans.  Every span of the four kinds holds a digit or an at sign, so a text is
read around those: regions of ``REACH`` characters to both sides, merged, and cut into overlapping
windows.  The windows' tag scores are brought together per character, by how central it is in each
window; then one Viterbi pass over the whole region decides on tags and a forward-backward pass on how
sure they are.  Spans that are sure and touch no base span are added; base spans always stay.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlog.llm.columns import field, map_batches, slices, texts_of, without

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
WINDOW, STEP, REACH = 64, 32, 24
HIDDEN = 16
SURE = 0.9  # least chance of each character of an added span
TRAINING_TEXTS, TRAINING_WINDOWS, EPOCHS = 2_000, 2_000, 12
LONGEST_TRAINED = 32_768

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False)]), False)

# The base patterns.  Possessive repeats and the look-behind only keep them linear; the matches are the same.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def passes_luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits summed: a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each at sign back over the local part and on over the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in LOCAL_LETTERS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and then by start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if TRIGGER.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) < 4 and int(p or 0) < 256 for g in m.groups())]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------------------------------------- windows


def regions(text: str) -> list[tuple[int, int]]:
    """What lies within REACH of a digit or an at sign, merged."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(start: int, end: int) -> list[int]:
    """Starts of overlapping windows over a region; the last one ends with it."""
    if end - start <= WINDOW:
        return [start]
    return [*range(start, end - WINDOW, STEP), end - WINDOW]


def codes(text: str):
    """Characters as small numbers: ASCII itself, then one each for other letters, digits, spaces and the rest."""
    import numpy as np

    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    return np.array([ord(c) if ord(c) < 128 else 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
                     for c in text], np.int64)


CODES = 133  # with 132 for padding


# ---------------------------------------------------------------------------------------------- network


@dataclass
class Tagger:
    """Per direction: input table (CODES x 4H, bias within) and recurrent matrix (H x 4H); output; transitions."""

    weights: list  # [table, recurrent] forward, the same backward, output (2H x TAGS), bias, transitions (TAGS x TAGS)


def _allowed():
    """A further character follows only the same kind."""
    import numpy as np

    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 * k + 2
        ok[:, inside] = False
        ok[inside - 1, inside] = ok[inside, inside] = True
    return ok


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-x))


def _run(table, recurrent, x):
    """One direction over x (T x B codes): outputs (T x B x H) and what the way back needs."""
    import numpy as np

    steps, batch = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, kept = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = table[x[t]] + h @ recurrent
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        before, was = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        kept.append((i, f, o, g, before, tc, was))
    return out, kept


def _back(recurrent, x, kept, dout, table_shape):
    import numpy as np

    dtable, drec, every = np.zeros(table_shape, np.float32), np.zeros_like(recurrent), np.empty((len(kept), len(dout[0]), 4 * HIDDEN), np.float32)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, before, tc, was = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = every[t]
        np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1, out=dz)
        drec += was.T @ dz
        dh, dc = dz @ recurrent.T, dc * f
    order = np.argsort(x, axis=None, kind="stable")
    used, first = np.unique(x.reshape(-1)[order], return_index=True)
    dtable[used] = np.add.reduceat(every.reshape(-1, 4 * HIDDEN)[order], first)
    return dtable, drec


def _log_sum(x, axis):
    import numpy as np

    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _forward_backward(e, trans, lengths):
    """Log potentials e (T x B x K): log alphas, log betas and log partition of sequences of the given lengths."""
    import numpy as np

    steps, batch, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        new = _log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        alpha[t] = np.where((t < lengths)[:, None], new, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        new = _log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where((t + 1 < lengths)[:, None], new, 0)
    return alpha, beta, _log_sum(alpha[-1], 1)


def _emissions(tagger: Tagger, x):
    import numpy as np

    table_f, rec_f, table_b, rec_b, out, bias, _ = tagger.weights
    forward, kept_f = _run(table_f, rec_f, x)
    backward, kept_b = _run(table_b, rec_b, x[::-1])
    both = np.concatenate([forward, backward[::-1]], 2)
    return both @ out + bias, both, kept_f, kept_b


def _gradients(tagger: Tagger, x, y, lengths):
    """Mean loss and gradients for windows x, tags y (T x B)."""
    import numpy as np

    trans = np.where(_allowed(), tagger.weights[6], -1e4).astype(np.float32)
    e, both, kept_f, kept_b = _emissions(tagger, x)
    steps, batch, _ = e.shape
    valid = np.arange(steps)[:, None] < lengths
    alpha, beta, z = _forward_backward(e, trans, lengths)
    de = np.exp(alpha + beta - z[:, None]) * valid[:, :, None]
    gold = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0]
    np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - valid[:, :, None], 2)
    dtrans = np.zeros_like(trans)
    path = (gold * valid).sum(0)
    for t in range(1, steps):
        use = valid[t]
        pair = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
        dtrans += pair[use].sum(0)
        np.add.at(dtrans, (y[t - 1][use], y[t][use]), -1)
        path += np.where(use, trans[y[t - 1], y[t]], 0)
    de /= batch
    flat = both.reshape(-1, 2 * HIDDEN)
    dout, dbias = flat.T @ de.reshape(-1, TAGS), de.sum((0, 1))
    dboth = de @ tagger.weights[4].T
    gf = _back(tagger.weights[1], x, kept_f, dboth[:, :, :HIDDEN], tagger.weights[0].shape)
    gb = _back(tagger.weights[3], x[::-1], kept_b, dboth[::-1, :, HIDDEN:], tagger.weights[2].shape)
    return float((z - path).mean()), [*gf, *gb, dout, dbias, dtrans / batch]


def _tags(spans, start: int, length: int):
    import numpy as np

    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if a < length and b > 0:
            k = 2 * KINDS.index(kind) + 1
            y[max(a, 0):min(b, length)] = k + 1
            if a >= 0:
                y[a] = k
    return y


def train_on(rows: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 0, epochs: int = EPOCHS) -> Tagger | None:
    """From (text, labelled spans); None without a labelled span.  Windows also hold what is not labelled."""
    import numpy as np

    rng = np.random.default_rng(seed)
    found = []
    for text, spans in rows:
        spans = [s for i, s in enumerate(spans) if all(s[2] <= o[1] or o[2] <= s[1] for o in spans[:i])]
        for a, b in regions(text):
            for w in windows(a, b):
                part = text[w:min(w + WINDOW, b)]
                found.append((codes(part), _tags([s for s in spans if s[1] < w + WINDOW and s[2] > w], w, len(part))))
    if not any(y.any() for _, y in found):
        return None
    found = [found[i] for i in rng.permutation(len(found))[:TRAINING_WINDOWS]]
    x, y = np.full((WINDOW, len(found)), CODES - 1, np.int64), np.zeros((WINDOW, len(found)), np.int64)
    for i, (c, t) in enumerate(found):
        x[:len(c), i], y[:len(t), i] = c, t
    # a window may begin inside a span: its first character then begins it
    further = (y[0] > 0) & (y[0] % 2 == 0)
    y[0, further] -= 1
    lengths = np.array([len(c) for c, _ in found])
    w = [rng.normal(0, 0.3, s).astype(np.float32) for s in (
        (CODES, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN), (CODES, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN), (2 * HIDDEN, TAGS))]
    w += [np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)]
    for table in (w[0], w[2]):
        table[:, HIDDEN:2 * HIDDEN] += 1  # remember at first
    tagger, size = Tagger(w), 100
    mean, square, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(found))
        for at in range(0, len(order), size):
            use = order[at:at + size]
            _, grads = _gradients(tagger, x[:, use], y[:, use], lengths[use])
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for p, g, m, s in zip(w, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
    return tagger


def tag_regions(tagger: Tagger, texts: list[str]):
    """For each text a list of (kind, start, end, least chance), decoded over whole regions."""
    import numpy as np

    out = [[] for _ in texts]
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    places.sort(key=lambda p: p[2] - p[1])
    trans = np.where(_allowed(), tagger.weights[6], -1e4).astype(np.float32)
    start_ok = np.array([0.0 if t == 0 or t % 2 else -1e4 for t in range(TAGS)], np.float32)
    at = 0
    while at < len(places):
        # regions of similar length, about 60,000 characters at a time
        most, group = places[at][2] - places[at][1], []
        while at < len(places) and (not group or (len(group) + 1) * (most := places[at][2] - places[at][1]) <= 60_000):
            group.append(places[at])
            at += 1
        cut = [(g, w, min(w + WINDOW, b)) for g, (_, a, b) in enumerate(group) for w in windows(a, b)]
        x = np.full((WINDOW, len(cut)), CODES - 1, np.int64)
        known = [codes(texts[i][a:b]) for i, a, b in group]
        for n, (g, w, end) in enumerate(cut):
            x[:end - w, n] = known[g][w - group[g][1]:end - group[g][1]]
        scores = _emissions(tagger, x)[0]
        longest = max(b - a for _, a, b in group)
        total, weight = np.zeros((longest, len(group), TAGS), np.float32), np.zeros((longest, len(group), 1), np.float32)
        for n, (g, w, end) in enumerate(cut):
            size, first = end - w, w - group[g][1]
            central = np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)).astype(np.float32)[:, None]
            total[first:first + size, g] += scores[:size, n] * central
            weight[first:first + size, g] += central
        e = total / np.maximum(weight, 1)
        e[0] += start_ok
        lengths = np.array([b - a for _, a, b in group])
        alpha, beta, z = _forward_backward(e, trans, lengths)
        chance = np.exp(alpha + beta - z[:, None])
        best, came = e[0], np.zeros((longest, len(group), TAGS), np.int64)
        for t in range(1, longest):
            ways = best[:, :, None] + trans
            came[t] = ways.argmax(1)
            best = np.where((t < lengths)[:, None], ways.max(1) + e[t], best)
        tag = best.argmax(1)
        path = np.zeros((longest, len(group)), np.int64)
        for t in range(longest - 1, -1, -1):
            path[t] = np.where(t < lengths, tag, 0)
            if t:
                tag = np.where(t < lengths, np.take_along_axis(came[t], tag[:, None], 1)[:, 0], tag)
        for g in np.flatnonzero(path.any(0)):
            i, a, _ = group[g]
            tags, t = path[:, g], 0
            while t < longest:
                if tags[t] % 2:
                    kind, end = tags[t], t + 1
                    while end < longest and tags[end] == kind + 1:
                        end += 1
                    # each character's chance to belong to the kind
                    sure = (chance[t:end, g, kind] + chance[t:end, g, kind + 1]).min()
                    out[i].append((KINDS[kind // 2], int(a + t), int(a + end), float(sure)))
                    t = end
                else:
                    t += 1
    return out


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; all spans by kind, then start."""
    base = [base_spans(t) for t in texts]
    tagged = tag_regions(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, own, new in zip(texts, base, tagged, strict=True):
        taken = sorted((a, b) for _, a, b in own)
        ends = [max(b for _, b in taken[:n + 1]) for n in range(len(taken))] if new else []
        more = []
        for kind, a, b, sure in new:
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
            n = bisect.bisect_left(taken, (b,))
            if sure >= SURE and b > a and TRIGGER.search(text, a, b) and not (n and ends[n - 1] > a):
                more.append((kind, a, b))
        out.append((own, sorted(own + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else own))
    return out


# ---------------------------------------------------------------------------------------------- frames


def labelled(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, spans) of a bounded sample to train on, labelled by the base patterns.

    The ``TRAINING_TEXTS`` texts with a digit or at sign of the smallest md5, of at most ``LONGEST_TRAINED`` characters.
    """
    rows = df.select(df[text].alias("text")).filter(
        F.col("text").rlike("[0-9@]") & (F.length("text") <= LONGEST_TRAINED)).withColumn("place", F.md5("text"))
    # the places alone meet in one task; equal texts count once
    last = rows.select("place").distinct().orderBy("place").limit(TRAINING_TEXTS).agg(F.max("place")).first()[0]
    rows = rows.filter(F.col("place") <= F.lit(last)).dropDuplicates(["place"]).select("text")

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(t)] for t in texts_of(batch.column(0))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["text", "spans"])

    return map_batches(rows, make, T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)]))


def train(rows: DataFrame, text: str = "text", spans: str = "spans") -> Tagger | None:
    """Train on labelled rows; they are collected, so hand over a bounded sample."""
    got = rows.select(rows[text].alias("text"), rows[spans].alias("spans")).collect()
    got.sort(key=lambda r: r.text or "")
    return train_on([(r.text or "", [(s.kind, s.start, s.end) for s in r.spans or ()]) for r in got])


def find(df: DataFrame, tagger: Tagger | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base`` and ``spans`` (kind, start, end; code points, end exclusive, by kind and start) of every whole text.

    Null texts have none; input columns of these names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(tagger)
    kept = without(df.columns if keep is None else keep, ["base", "spans"])
    schema = T.StructType([*(field(df, c) for c in kept), T.StructField("base", SPANS, False), T.StructField("spans", SPANS, False)])
    width = len(kept)

    def make(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def column(lists):
            return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in lists], kind)

        for batch in batches:
            for part in slices(batch, width):
                found = all_spans(texts_of(part.column(width)), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], column(b for b, _ in found), column(s for _, s in found)], names=schema.names)

    return map_batches(df.select(*(df[c] for c in kept), df[text].alias("__text")), make, schema)


def masked(df: DataFrame, tagger: Tagger | None, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one.  Null stays."""
    sent = df.sparkSession.sparkContext.broadcast(tagger)
    at = df.columns.index(text)

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                found = all_spans([t or "" for t in texts], sent.value)
                new = [t if t is None or not s else _mask(t, s) for t, (_, s) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = map_batches(df, make, df.schema)
    return out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)) if n_chars in df.columns else out


def _mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]
