"""Operator 8: personal data by boosted trees over candidate spans.

The base kinds (email, ip, card, phone) are found by fixed patterns with fixed
checks.  High-recall generators then propose overlapping spans of every kind: single
cards of a run of digit groups that the base pattern took as one, addresses in longer
dotted runs or with bracketed dots, local phone numbers, identity numbers, written-out
mail addresses ("at", "dot") and long tokens.  What a check can decide (digit sums,
numbers up to 255) the generators check; it is neither a feature nor a label.

Gradient-boosted trees over format and context features give each candidate a chance.
They learn from a bounded sample of documents: candidates proposed with the base
patterns switched off, marked by whether they meet a base span, and made-up items and
look-alikes put into the same texts, marked by which of the two they are.  No key
words are used on either side.  Each kind has a threshold at which its precision
reaches ``precision`` on the same of documents kept out of the training (the held-out
fold); a kind that never does selects nothing.  Of overlapping selected candidates
the likeliest stays; a base span always stays.

Cases: a null text counts as the empty text, which has no spans; offsets are code
points, ends exclusive; repeated rows each give a row; other columns are ignored;
rows without doc_id are searched like others and not sampled; an empty table gives no
rows, and an empty sample trains on made-up data alone.  All searches take time in
proportion to a text's length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .learning import bounded_sample, held_out, sigmoid, with_ids

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
#: Documents sampled, candidates taken of one of them, candidates that train the trees; the precision asked of a kind.
SAMPLE, PER_DOCUMENT, ROWS, PRECISION = 1500, 40, 12_000, 0.98

# ---- base spans ------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: a local part begins as far left of its @ as it can."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_PART:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((begin, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return out


def _quads(text: str) -> list[tuple[int, int, list[str]]]:
    """Runs of four dotted numbers, each run of dotted numbers cut from the left."""
    out = []
    for m in _DOTTED.finditer(text):
        groups = m.group().split(".")
        at = m.start()
        for k in range(0, len(groups) - 3, 4):
            size = sum(map(len, groups[k : k + 4])) + 3
            out.append((at, at + size, groups[k : k + 4]))
            at += size + 1
    return out


def _octets(groups: list[str]) -> bool:
    return all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in groups)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", a, b) for a, b, groups in _quads(text) if _octets(groups)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


# ---- candidates ------------------------------------------------------------------------------------------------

_GROUPS = re.compile(r"[0-9]+")
_LOCAL = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")
_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_BRACKETED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\sat\s)\s?[A-Za-z0-9-]{1,64}(?:\s?(?:\[dot\]|\(dot\)|\sdot\s)\s?[A-Za-z0-9-]{1,64}){1,8}", re.I)
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans, which may overlap each other; base spans are not proposed again."""
    found = set()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            groups = [g.span() for g in _GROUPS.finditer(text, m.start(), m.end())]
            for i, (a, _) in enumerate(groups):
                size = 0
                for x, b in groups[i : i + 19]:
                    size += b - x
                    if size > 19:
                        break
                    if size >= 13 and luhn(_DIGITS.sub("", text[a:b])):
                        found.add(("card", a, b))
    found.update(("email", a, b) for a, b in _emails(text))
    for m in _DOTTED.finditer(text):
        groups = m.group().split(".")
        if len(groups) >= 4:
            ends = np.cumsum([len(g) + 1 for g in groups]) + m.start()
            found.update(("ip", int(ends[k]) - len(groups[k]) - 1, int(ends[k + 3]) - 1) for k in range(len(groups) - 3) if _octets(groups[k : k + 4]))
    if "[" in text or "(" in text:
        found.update(("ip", *m.span()) for m in _BRACKETED.finditer(text) if _octets(_GROUPS.findall(m.group())))
    found.update(("phone", *m.span()) for m in _LOCAL.finditer(text))
    found.update(("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15)
    found.update(("id", *m.span()) for m in _ID.finditer(text))
    if re.search(r"[\[( ]at[\]) ]", text, re.I) and re.search(r"[\[( ]dot[\]) ]", text, re.I):
        found.update(("email", *m.span()) for m in _WRITTEN.finditer(text))
    found.update(("secret", *m.span()) for m in _LONG.finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group()))
    return sorted(found.difference(base))


WIDTH = len(KINDS) + 24
_VOWEL = frozenset("aeiouyAEIOUY")


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of one candidate."""
    span = text[start:end]
    some = span[:200]
    digits = _DIGITS.sub("", some)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    side = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isdigit() else 2.0 if c.isalpha() else 3.0
    groups = [len(g) for g in _GROUPS.findall(some)]
    letters = [c for c in some if c.isalpha()]
    shares = np.unique(list(some), return_counts=True)[1] / len(some)
    trimmed = before.rstrip()
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(some, some[1:]))
    words = before.split()
    return [
        *(float(kind == k) for k in KINDS), float(min(end - start, 200)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(groups[0] if groups else 0), float(groups[-1] if groups else 0), float(len(set(digits))), float(int(digits[0]) if digits else -1),
        float(len(letters)), float(sum(c.isupper() for c in letters)), float(sum(c in _VOWEL for c in letters) / max(1, len(letters))), float(max(map(int, _GROUPS.findall(some[:19])), default=0) if kind == "ip" else 0),
        float(-(shares * np.log2(shares)).sum()), float(turns / len(some)), float(sum(not c.isalnum() for c in some)),
        side(text[start - 1 : start] if start else ""), side(text[end : end + 1]), float(trimmed[-1:] in (":", "=")), float(before[-1:] in ("\"", "'") and after[:1] in ("\"", "'")),
        float(trimmed[-1:] in (".", ",", ";")), float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)), float(len(words[-1]) if words else 0),
    ]


# ---- boosted trees ---------------------------------------------------------------------------------------------


class Trees:
    """Gradient boosting of the logistic loss; trees of fixed depth over binned features."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, held: float = 4.0):
        self.count, self.depth, self.rate, self.bins, self.held = trees, depth, rate, bins, held
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(share / (1 - share)))
        out = np.full(len(x), self.start)
        for _ in range(self.count):
            p = sigmoid(out)
            g, h = y - p, p * (1 - p)
            nodes = (1 << self.depth) - 1
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                for k in range(first, 2 * first + 1):
                    own = np.flatnonzero(node == k)
                    best = (1e-6, 0, -1)
                    if len(own) >= 10:
                        tg, th = g[own].sum(), h[own].sum()
                        for f in range(x.shape[1]):
                            if not len(cuts[f]):
                                continue
                            lg = np.cumsum(np.bincount(binned[own, f], g[own], len(cuts[f]) + 1))[:-1]
                            lh = np.cumsum(np.bincount(binned[own, f], h[own], len(cuts[f]) + 1))[:-1]
                            gain = lg**2 / (lh + self.held) + (tg - lg) ** 2 / (th - lh + self.held) - tg**2 / (th + self.held)
                            c = int(gain.argmax())
                            best = max(best, (float(gain[c]), f, c))
                    if best[2] >= 0:
                        feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - nodes
            value = self.rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + self.held)
            self.grown.append((feature, cut, value))
            out += value[leaf]
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Chances."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.grown:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return sigmoid(out)


class Model:
    """Trees, thresholds by kind, and what the held-out documents gave: by kind (candidates, precision, recall) at the threshold."""

    def __init__(self, trees: Trees, threshold: dict[str, float], measured: dict[str, tuple[int, float, float]] | None = None):
        self.trees, self.threshold, self.measured = trees, threshold, measured or {}

    def chosen(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates beyond the base spans that reach their thresholds, the likeliest of those that overlap."""
        more = candidates(text, base)
        if not more:
            return []
        chance = self.trees(np.array([describe(text, *c) for c in more]))
        taken = Taken((a, b) for _, a, b in base)
        ranked = sorted(zip(chance.tolist(), more), key=lambda x: (-x[0], -(x[1][2] - x[1][1]), x[1]))
        return [c for p, c in ranked if p >= self.threshold[c[0]] and taken.add(c[1], c[2])]

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        added = self.chosen(text, base)
        return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


class Taken:
    """Stretches of a text; those that overlap are one."""

    def __init__(self, spans):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Takes the stretch if it is free."""
        k = bisect_right(self.begins, a)
        if (k and self.ends[k - 1] > a) or (k < len(self.begins) and self.begins[k] < b):
            return False
        self.begins.insert(k, a)
        self.ends.insert(k, b)
        return True


# ---- training --------------------------------------------------------------------------------------------------


def _number(rng: random.Random, n: int) -> str:
    return "".join(str(rng.randint(0, 9)) for _ in range(n))


def _summed(body: str) -> str:
    return body + next(c for c in "0123456789" if luhn(body + c))


def _word(rng: random.Random, text: str) -> str:
    """A word of the text, or letters."""
    found = [w for w in (text[k : k + 9].split() or [""] for k in (rng.randrange(max(1, len(text))),)) if w[-1].isalpha()]
    return found[0][-1].strip(".,") if found and rng.random() < 0.7 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))


def _made_up(rng: random.Random, text: str) -> tuple[str, str, int, int, int]:
    """A text with one made-up item or look-alike, its kind and place, and whether it is personal."""
    kind, personal = rng.choice(KINDS), rng.random() < 0.5
    word = lambda: _word(rng, text) or "of"
    pick = rng.choice
    left, right = pick((" ", " ", ": ", " (", "\n", '"')), pick((" ", " ", ", ", ". ", ")", "\n", '"'))
    if kind == "email":
        at, dot = pick(((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]")))
        made = f"{word()}{pick(('', '.', '_'))}{_number(rng, rng.randint(0, 3))}{at}{word()}{dot}{pick(('com', 'org', 'net', 'de', 'fr'))}" if personal else f"{word()} at {pick(('the', 'a', word()))} dot {word()}"
    elif kind == "ip":
        made = pick((".", "[.]", "(.)", ".")).join(str(rng.randint(1, 254)) for _ in range(4)) if personal else ".".join(str(rng.randint(0, 12)) for _ in range(rng.randint(4, 6)))
    elif kind == "card":
        if personal:
            made = _summed(pick("3456") + _number(rng, 14))
            made = pick((made, pick(" -").join(made[i : i + 4] for i in range(0, 16, 4))))
        else:
            made = _summed(pick("0123456789") + _number(rng, rng.randint(11, 17)))
            left = pick(("-", "/", "_", "x", "0.", "#"))
        beside = rng.random()
        if beside > 0.7 and personal:
            right = f" {_number(rng, 16)} "
        if beside < 0.3:
            left = f" {_number(rng, 16)} " if personal else f" {_number(rng, rng.randint(2, 9))}{left}"
    elif kind == "phone":
        area, middle, rest = pick("23456789") + _number(rng, 2), _number(rng, 3), _number(rng, 4)
        if personal:
            made = pick(("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}")).format(area, middle, rest)
        else:
            made = pick(("{}-{}-{}", "{} {} {}", "{}.{}.{}")).format(_number(rng, 3), middle, rest)
            left, right = pick(("-", "/", "#", "x", "." + left, " " + _number(rng, 3) + " ")), pick(("-" + _number(rng, 2), "/", "." + _number(rng, 3), "x"))
    elif kind == "id":
        made = f"{_number(rng, 3)}-{_number(rng, 2)}-{_number(rng, 4)}"
        if not personal:
            left, right = pick(("-", "/", "A", "#", _number(rng, 2) + "-")), pick(("-", "/", "B", "-" + _number(rng, 2)))
    elif personal:
        letters = pick(("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        made = "".join(pick(letters) for _ in range(pick((24, 32, 40, 48, 64))))
        left, right = pick((left, ' = "', ": ", "=")), pick((right, '" '))
    else:
        made = pick("-_/").join(word() for _ in range(rng.randint(4, 8))) + pick(("", "-")) + _number(rng, rng.randint(1, 4))
    at = rng.randint(0, len(text))
    while at < len(text) and not text[at].isspace():
        at += 1
    head = text[:at] + left
    return head + made + right + text[at:].lstrip(), kind, len(head), len(head) + len(made), int(personal)


def _met(c: tuple[str, int, int], spans: list[tuple[str, int, int]]) -> bool:
    return any(k == c[0] and a < c[2] and c[1] < b for k, a, b in spans)


def examples(text: str, rng: random.Random, most: int = PER_DOCUMENT, made_up: int = 8) -> list[tuple[list[float], int]]:
    """Candidates of a text with their marks: its own, with the base patterns switched off, and those of made-up items put into it."""
    base = base_spans(text)
    own = [c for c in candidates(text, []) if c[0] in BASE_KINDS]
    rows = [(describe(text, *c), int(_met(c, base))) for c in (rng.sample(own, most) if len(own) > most else own)]
    at = rng.randint(0, max(0, len(text) - 200))
    for _ in range(made_up):
        made, kind, a, b, mark = _made_up(rng, text[at : at + 200])
        rows += [(describe(made, *c), mark) for c in candidates(made, []) if c[0] == kind and c[1] < b and a < c[2]]
    return rows


def train(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION, most: int = ROWS, seed: int = 8) -> Model:
    """Learns from a bounded sample of documents; thresholds are set on those of the held-out fold among them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scratch.text_of()).where("doc_id is not null").withColumn("held", held_out())
    ids = bounded_sample(docs.select("doc_id"), sample, 5)

    def learn(frames):
        for frame in frames:
            rows = []
            for doc, text, held in zip(frame["doc_id"], frame["text"], frame["held"]):
                rows += [(*r, bool(held)) for r in examples(text, random.Random(seed * 1_000_003 + int(doc)))]
            yield pd.DataFrame({"x": [np.array(r[0], "<f4").tobytes() for r in rows], "y": [r[1] for r in rows], "held": [r[2] for r in rows]})

    got = with_ids(docs, ids).mapInPandas(learn, "x binary, y int, held boolean").collect() if ids else []
    rows = sorted((bytes(r["x"]), r["y"], r["held"]) for r in got)
    rng = random.Random(seed)
    while len(rows) < 3000:  # too few documents: made-up items in made-up texts
        held = rng.random() < 0.2
        rows += [(np.array(x, "<f4").tobytes(), y, held) for x, y in examples("a few words of no importance stand here and there", rng)]
    rng.shuffle(rows)
    table = lambda part: (np.stack([np.frombuffer(r[0], "<f4") for r in part]).astype(np.float64), np.array([r[1] for r in part], np.float64))
    x, y = table([r for r in rows if not r[2]][:most])
    tx, ty = table([r for r in rows if r[2]])
    trees = Trees().fit(x, y)
    chance, threshold, measured = trees(tx), {}, {}
    for k, kind in enumerate(KINDS):
        own = tx[:, k] == 1
        p, t = chance[own], ty[own]
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero((right >= precision) & (np.diff(p[order], append=-1.0) != 0))  # equal chances pass together
        threshold[kind] = float(p[order][good[-1]]) if len(good) >= 10 else 2.0
        taken = p >= threshold[kind]
        measured[kind] = (int(own.sum()), float(t[taken].mean()) if taken.any() else 0.0, float(t[taken].sum() / max(1.0, t.sum())))
    return Model(trees, threshold, measured)


# ---- the operator ----------------------------------------------------------------------------------------------


def written_out(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base, every = shared.value.spans(text)
                rows.append([*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(every)])
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    made = docs.select(scratch.id_in("doc_id"), scratch.text_of()).mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return made.withColumn("doc_id", scratch.id_out("doc_id"))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with their texts redacted and n_chars, where there is one, counted anew; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else redact_text(t, shared.value.spans(t)[1]))

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, train(docs))
