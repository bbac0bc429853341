"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over all character subsequences of length 4 that they share, a decay
for every position that an occurrence spans (Lodhi et al. 2002). Occurrences may span up to ``SPAN``
characters, twice their length less one, so that a letter inserted after each letter of an insult
leaves all its subsequences in reach. Landmark strings give each text unit a Nystroem representation, and a linear support
vector machine on it is trained by multiple-instance rounds: labels are known for documents, and in
each round the unit of a toxic document that scores highest stands for it. A unit is a
white-space token without its signs; tokens of single letters in a row are one unit; digits that stand
for letters by their looks (``LOOKS``) are those letters in units that have letters. A document's score
comes from its strongest distinct units.

The kernel is linear in its (implicit) feature vector, so the fitted machine folds into one weight
for each four-symbol subsequence: every position of every whole text is scored by table look-ups,
with no candidate filter.

Fitting takes a bounded sample: ``FIT_ROWS`` labelled rows with all their units, of which ``UNITS``
distinct clean ones are compared. Texts are split into units where they are read; the driver gets the
distinct units of each document alone.

Edge cases: a null or empty text scores as a text without units; without labels of both kinds every
score is 0; repeated rows each get a row; a document with several labels is toxic if any says so; of
several texts with one id the least is learned from; rows with a null id are never learned from and
count as held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .arrays import chunks, code_points
from .common import read_table, release
from .quality import held_out, labelled_texts, scored, sigmoid

FIT_ROWS, UNITS = 6_000, 12_000
POSITIVE, NEGATIVE = 144, 24
SPAN, DECAY = 7, 0.6
#: Digits and the letters that they look like.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SYMBOLS = 32
#: Positions of a subsequence's second to fourth symbol after its first, and its weight.
STEPS = [(a, b, c, DECAY ** (c + 1)) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
#: A document is scored by this many of its strongest distinct units.
STRONGEST = 3


@cache
def symbol_table() -> np.ndarray:
    """0: signs, other digits and white space; a to z and digits like them one by one; letters beyond
    ASCII share five symbols."""
    out = np.zeros(0x10001, np.int64)
    for i in range(128, 0x10001):
        if i == 0x10000 or chr(i).isalpha():
            out[i] = 27 + i % 5
    for i in range(26):
        out[97 + i] = 1 + i
    for digit, letter in LOOKS.items():
        out[ord(digit)] = out[ord(letter)]
    return out


class Units:
    """The units of some texts: their symbols one after the other, each unit between blanks."""

    def __init__(self, texts: list[str]):
        cps, bounds = code_points([f" {t.lower()} " for t in texts])
        sym = symbol_table()[np.minimum(cps, 0x10000)]
        space = (cps == 32) | ((cps >= 9) & (cps <= 13)) | (cps == 0xA0)
        solid = np.zeros(len(cps) + 2, bool)
        solid[1:-1] = ~space
        first = np.flatnonzero(~solid[:-2] & solid[1:-1])
        letters = np.concatenate([[0], np.cumsum(sym > 0)])
        stop = np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
        # Digits are letters only where a true letter stands with them.
        true = np.concatenate([[0], np.cumsum((sym > 0) & ((cps < 48) | (cps > 57)))])
        plain = np.flatnonzero((true[stop] == true[first]) & (letters[stop] > letters[first]))
        if len(plain):
            drop = np.zeros(len(sym) + 1, np.int64)
            np.add.at(drop, first[plain], 1)
            np.add.at(drop, stop[plain], -1)
            sym = np.where(np.cumsum(drop[:-1]) > 0, 0, sym)
            letters = np.concatenate([[0], np.cumsum(sym > 0)])
        size = letters[stop] - letters[first]
        first, stop, size = first[size > 0], stop[size > 0], size[size > 0]
        doc = np.searchsorted(bounds, first, side="right") - 1
        join = np.zeros(len(first), bool)
        join[1:] = (size[1:] == 1) & (size[:-1] == 1) & (doc[1:] == doc[:-1])
        group = np.cumsum(~join) - 1
        n = int(group[-1]) + 1 if len(group) else 0
        self.doc = doc[~join]
        self.size = np.bincount(group, weights=size, minlength=n).astype(np.int64)
        self.cps, self.kept = cps, np.flatnonzero(sym > 0)
        # Signs between the letters of a unit are left out; one blank stands before each unit.
        self.start = np.cumsum(self.size + 1) - self.size
        self.end = self.start + self.size
        self.sym = np.zeros(int(self.end[-1]) + SPAN + 1 if n else SPAN + 1, np.int64)
        self.sym[np.arange(len(self.kept)) + np.repeat(np.arange(n), self.size) + 1] = sym[self.kept]

    def strings(self) -> list[str]:
        text = self.cps[self.kept].astype("<u4").tobytes().decode("utf-32-le")
        ends = np.cumsum(self.size)
        return [text[b - n : b] for b, n in zip(ends.tolist(), self.size.tolist(), strict=True)]


def codes(sym: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    n = len(sym) - c
    return ((sym[:n] * SYMBOLS + sym[a : a + n]) * SYMBOLS + sym[b : b + n]) * SYMBOLS + sym[c:]


def spread(u: Units):
    """(unit, subsequence code, weight) of every occurrence inside the units and their blanks."""
    begin, stop = u.start - 1, u.end + 1
    owner = np.full(len(u.sym), -1)
    for shift in (0, 1):  # a blank belongs to the unit after it as a start, to the one before as an end
        owner[begin + shift] = np.arange(len(begin))
    owner[np.arange(int(u.size.sum())) + np.repeat(np.arange(len(begin)), u.size) + 1] = np.repeat(np.arange(len(begin)), u.size)
    for a, b, c, weight in STEPS:
        code = codes(u.sym, a, b, c)
        own = owner[: len(code)]
        ok = own >= 0
        ok[ok] = np.flatnonzero(ok) + c < stop[own[ok]]
        yield own[ok], code[ok], weight


def lengths_norm(size: np.ndarray) -> np.ndarray:
    """The norm of a unit's feature vector if no subsequence repeats in it, by its length."""
    square = np.zeros(len(size))
    for *_, c, weight in STEPS:
        square += weight**2 * np.maximum(size + 2 - c, 0)
    return np.sqrt(np.maximum(square, STEPS[0][3] ** 2))


class KernelMachine:
    """Folded weights of all subsequences, and the calibration of the document score."""

    def __init__(self, table: np.ndarray, bias: float, scale: tuple[float, float]):
        self.table, self.bias, self.scale = table, bias, scale

    def margins(self, texts: list[str]) -> np.ndarray:
        """The sum of the largest margins of distinct units of each text, each between 0 and 1."""
        out = np.zeros(len(texts))
        for a, b in chunks(texts, 500_000):
            u = Units(texts[a:b])
            value = np.minimum(np.round(self.unit_margins(u), 5), 1)
            on = value > 0
            if on.any():
                pairs = np.unique(np.stack([u.doc[on].astype(float), -value[on]]), axis=1)
                doc = pairs[0].astype(int)
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                np.add.at(out, a + doc[place < STRONGEST], -pairs[1][place < STRONGEST])
        return out

    def unit_margins(self, u: Units) -> np.ndarray:
        """Sums of table entries over every unit, as differences of running totals."""
        total = np.zeros(len(u.start))
        n = len(u.sym)
        begin = u.start - 1
        first = u.sym.astype(np.int32) * SYMBOLS
        second = {a: (first[: n - a] + u.sym[a:].astype(np.int32)) * SYMBOLS for a in range(1, SPAN - 2)}
        for c in range(3, SPAN):
            # Occurrences of one span share a weight and the places where they may begin.
            found = np.zeros(n - c)
            for b in range(2, c):
                tail = u.sym[b : n - c + b].astype(np.int32) * SYMBOLS + u.sym[c:].astype(np.int32)
                for a in range(1, b):
                    found += self.table[second[a][: n - c] * SYMBOLS + tail]
            run = np.zeros(n + 1)
            np.cumsum(found, out=run[1 : n - c + 1])
            total += DECAY ** (c + 1) * (run[np.maximum(u.end + 1 - c, begin)] - run[begin])
        return total / lengths_norm(u.size) + self.bias

    def bag_margins(self, bags: list[list[str]]) -> np.ndarray:
        """The same as ``margins`` for texts that are given by their distinct units."""
        names = sorted({w for bag in bags for w in bag})
        value = dict(zip(names, np.minimum(np.round(self.unit_margins(Units(names)), 5), 1).tolist(), strict=True))
        return np.array([sum(sorted({v for w in bag if (v := value[w]) > 0}, reverse=True)[:STRONGEST]) for bag in bags])

    def score(self, texts: list[str]) -> np.ndarray:
        k, c = self.scale
        return sigmoid(k * self.margins(texts) + c)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """K(word, landmark) for single units."""
    entries = list(spread(Units(landmarks)))
    used = np.unique(np.concatenate([code for _, code, _ in entries]))
    place = np.full(SYMBOLS**4, -1, np.int32)
    place[used] = np.arange(len(used))
    z = np.zeros((len(used), len(landmarks)), np.float32)
    for own, code, w in entries:
        np.add.at(z, (place[code], own), w)
    out = np.zeros((len(words), len(landmarks)))
    for s in range(0, len(words), 2_000):
        part = words[s : s + 2_000]
        for own, code, w in spread(Units(part)):
            at = place[code]
            own, at = own[at >= 0], at[at >= 0]
            if len(own):
                heads = np.flatnonzero(np.diff(own, prepend=-1))
                out[s + own[heads]] += w * np.add.reduceat(z[at], heads)
    return out / lengths_norm(np.array([len(w) for w in words]))[:, None]


def bags_of(texts: list[str]) -> list[list[str]]:
    """The distinct units of each text."""
    out: list[list[str]] = []
    for a, b in chunks(texts):
        found: list[set[str]] = [set() for _ in range(b - a)]
        u = Units(texts[a:b])
        for d, word in zip(u.doc.tolist(), u.strings(), strict=True):
            found[d].add(word)
        out += [sorted(bag) for bag in found]
    return out


def fit(texts: list[str], labels: np.ndarray, **options) -> KernelMachine:
    return fit_bags(bags_of(texts), labels, **options)


def fit_bags(bags: list[list[str]], labels: np.ndarray, *, rounds: int = 4, cost: float = 1.0, seed: int = 3) -> KernelMachine:
    toxic = labels > 0
    empty = KernelMachine(np.zeros(SYMBOLS**4, np.float32), 0.0, (0.0, -30.0))
    if not toxic.any() or toxic.all():
        return empty
    rng = np.random.default_rng(seed)
    df = [Counter(), Counter()]
    for bag, t in zip(bags, toxic, strict=True):
        df[int(t)].update(bag)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    lift = {w: np.log((c + 0.1) / n1) - np.log((df[0][w] + 0.5) / n0) for w, c in df[1].items() if c >= 2}
    # Units that stand out in toxic documents by more than chance start as their witnesses.
    steady = max(3, 0.004 * n1)
    ranked = sorted((w for w in lift if df[1][w] >= steady and lift[w] > 1.5), key=lambda w: (-lift[w] * np.log1p(df[1][w]), w))
    if not ranked:
        return empty
    clean = sorted(df[0])
    drawn = [clean[i] for i in rng.permutation(len(clean))[: UNITS // 4]]
    common = [w for w, _ in df[0].most_common(UNITS // 2)]
    marks = ranked[:POSITIVE] + [w for w in common if w not in lift or lift[w] < 0.3][:NEGATIVE]
    # Nystroem: x -> K(x, marks) K(marks, marks)^(-1/2)
    kzz = kernel(marks, marks) * lengths_norm(np.array([len(w) for w in marks]))[:, None]
    norm = np.sqrt(np.diag(kzz)) + 1e-9
    values, vectors = np.linalg.eigh(kzz / norm[:, None] / norm)
    keep = values > 1e-3 * values.max()
    project = vectors[:, keep] / np.sqrt(values[keep]) / norm[:, None]
    known: dict[str, np.ndarray] = {}

    def rows_of(words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in known]
        known.update(zip(fresh, kernel(fresh, marks) @ project, strict=True))
        return np.array([known[w] for w in words])

    toxic_bags = [bags[i] for i in np.flatnonzero(toxic) if bags[i]]
    # Witnesses with one inserted letter train the tolerance; the kernel supplies the likeness.
    gapped = []
    for w in ranked[:POSITIVE]:
        if len(w) >= 5:
            for i in rng.choice(np.arange(1, len(w)), 2, replace=False).tolist():
                gapped.append(w[:i] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + w[i:])
    gapped = sorted({w for w in gapped if not df[0][w]})
    suspects = sorted(df[1])
    value = {w: (lift[w] if w in set(ranked) else -1.0) for w in suspects}
    negative = dict.fromkeys(w for w in [*common, *drawn] if value.get(w, -1) < 0)
    for turn in range(rounds):
        witness: Counter = Counter()
        for bag in toxic_bags:
            best = max(bag, key=lambda w: (value[w], w))
            if value[best] > 0:
                witness[best] += 1
                witness.update(w for w in bag if w != best and value[w] > 0.5)
        if not witness:
            return empty
        pos = sorted(w for w, c in witness.items() if c / n1 > 2 * df[0][w] / n0)
        neg = [w for w in negative if w not in set(pos)]
        x = rows_of([*pos, *gapped, *neg])
        y = np.concatenate([np.ones(len(pos) + len(gapped)), -np.ones(len(neg))])
        c = np.sqrt(np.array([*(2.0 * witness[w] for w in pos), *(0.04 for _ in gapped), *(1.0 * df[0][w] for w in neg)])) * cost
        weight, bias = squared_hinge(x, y, c)
        beta = project @ weight
        table = np.zeros(SYMBOLS**4, np.float32)
        for own, code, w in spread(Units(marks)):
            np.add.at(table, code, (w * beta[own]).astype(np.float32))
        machine = KernelMachine(table, float(bias), (1.0, 0.0))
        if turn + 1 < rounds:
            value = dict(zip(suspects, machine.unit_margins(Units(suspects)).tolist(), strict=True))
            hard = machine.unit_margins(Units(clean))
            for i in np.argsort(-hard)[: UNITS // 4]:
                if hard[i] > -0.9:
                    negative[clean[i]] = None
    margins = machine.bag_margins(bags)
    # A threshold that fits stands at a score of 0.7: of those that fit about as well as the best the
    # highest that one strong unit still passes, so that clean documents are left alone. The slope
    # comes from the spread.
    order = np.sort(np.unique(margins))
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    hits = np.array([toxic[margins > t].sum() for t in cuts])
    taken = np.array([(margins > t).sum() for t in cuts])
    f1 = 2 * hits / (taken + n1)
    fitting = cuts[f1 >= f1.max() - 0.01]
    best = float(max(fitting[fitting <= 0.9], default=fitting.min()))
    k = max(3.0, 4.0 / max(best, 0.1))
    return KernelMachine(table, float(bias), (k, float(np.log(0.7 / 0.3) - k * best)))


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for an L2-regularised squared-hinge support vector machine with a bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    cost = lambda w: 0.5 * w @ ridge @ w + (c * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    now = cost(w)
    for _ in range(steps):
        slack = 1 - y * (z @ w)
        on = slack > 0
        grad = ridge @ w - 2 * z[on].T @ (c[on] * y[on] * slack[on])
        step = np.linalg.solve(ridge + 2 * (z[on].T * c[on]) @ z[on], grad)
        size = 1.0
        while size > 1e-4 and cost(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, cost(w)
        if before - now < 1e-6 * abs(before):
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs, labels) -> KernelMachine:
    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags_of(batch.column(2).to_pylist()), pa.list_(pa.string()))], ["id", "y", "bag"])

    chosen = labelled_texts(docs, labels, "toxic", keep=~held_out("doc_id", 3, 1), rows=FIT_ROWS, how=F.max)
    kind = dict(docs.dtypes)["doc_id"]
    rows = chosen.mapInArrow(split, f"id {kind}, y double, bag array<string>").orderBy(F.xxhash64("id"), "id").select("y", "bag").toArrow()
    names: dict[str, str] = {}
    bags = [[names.setdefault(w, w) for w in bag.as_py()] for bag in rows.column("bag")]
    y = rows.column("y").to_numpy()
    del rows
    machine = fit_bags(bags, y)
    del bags, names
    release()
    return machine


def op8(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    machine = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    out = scored(docs, machine.score)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
