"""Personal data by a skip-chain conditional random field.

The nodes of the field are the tokens that hold a digit, an at sign, or "at" in brackets; all
other tokens are observed as outside. Neighbouring nodes are linked as in a chain. Skip edges
link each node with the last one of the same document, however far back, that has the same
form (equal once folded, or the same last seven digits), and with the last one of a similar
shape (as many digits, as many hexadecimal digits, four dotted numbers, the same mail domain).
Loopy sum-product messages over all edges run until they settle, so an entity that is plain at
one place lends its label to its weaker mentions anywhere in the text.

Patterns find the base spans, and the field adds spans where its marginal is at least SURE:
further mentions of the four kinds, and secrets (values that are assigned to a token, password
or key), which have a list of their own.

The weights are learned here by pseudo-likelihood from a bounded sample: SAMPLE distinct texts
with such tokens, by a hash. Their labels are not the base spans alone: to a sampled text
further mentions of its entities are added (as they are, with a digit changed, or cut short),
which only their links to the first mention tell from other numbers, and tokens that just miss
a pattern are left out of the likelihood where the text holds an entity of that kind, and are
outside where it does not. Labelling itself reads whole texts of all rows.

Offsets are code points, ends exclusive. Defined results: a null text is an empty one and has
no span; of overlapping base spans of several kinds all stay, added spans overlap no other;
rows are labelled one by one, so repeats get equal spans; a very long text is labelled whole; an
empty table gives no rows, and without any sample the field adds nothing; other columns are not
used, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, views, with_fields

#: The kinds in their order and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words that tell what the value after them is, by kind; the last one is a secret.
CUES = (
    re.compile(r"e-?mail|mailto|write to|contact", re.I),
    re.compile(r"\bip\b|address|host|server|client", re.I),
    re.compile(r"card|visa|credit|iban|account", re.I),
    re.compile(r"phone|tel\b|mobile|call|fax", re.I),
    re.compile(r"(token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key)\W{0,3}\s*[:=]\s*[\"']?$", re.I),
)

SAMPLE = 2000
SURE = 0.9
SECRET = len(KINDS)
LABELS = 2 + len(KINDS)
#: Edges of the field: along the chain, between equal forms, between similar shapes.
CHAIN, SAME, SIMILAR = 0, 1, 2
#: Messages have settled when none changes by more.
SETTLED = 1e-4
#: Characters before a token in which cues are looked for.
LOOK_BACK = 24

_REST = re.compile(r"(?:[0-9@]|[(\[][aA][tT][)\]])\S*")
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_MARKS = np.zeros(256, bool)
_MARKS[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """What the pattern local@domain finds from left to right. The local part has no at sign,
    so a match is the run of local characters before one (from the last match on)."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers from left to right, each time behind the last match, with parts of
    at most 255."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, *s) for s in emails(text)]
    out += [(1, *x) for x in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_EDGE = ".,;:!?\"'()[]|#$%&*<>"


def features(token: str, context: str, before: str, after: str) -> list[bool]:
    """What a node sees of its own token, of the characters before it, and of the nodes right
    beside it."""
    core = token.strip(_EDGE)
    d = _digits(core)
    dots = core.count(".")
    plain = core.replace("-", "").replace(" ", "")
    decimal = plain.isdecimal()
    mail = _AT.split(core)
    return [
        True,
        len(mail) > 1,
        len(mail) > 1 and bool(mail[0]) and bool(DOMAIN.search(mail[-1])),
        "@" in core and bool(DOMAIN.search(core.rpartition("@")[2])) and core[0] != "@",
        dots == 3 and core.replace(".", "").isdecimal(),
        dots == 3 and all(p.isdecimal() and _octet(p) for p in core.split(".")),
        token.startswith("+"),
        token.startswith("(") and decimal,
        decimal and 16 <= len(d) <= 19,
        decimal and 16 <= len(d) <= 19 and luhn(d),
        decimal and len(d) == 4,
        decimal and 7 <= len(d) <= 15,
        decimal and len(d) < 4,
        bool(re.search("[A-Za-z]", core)),
        "-" in core and decimal,
        before.startswith(("+", "(")),
        bool(after) and after.strip("-.,()").isdecimal(),
        len(d) >= 20,
        bool(re.fullmatch("[0-9]+[.)]?", token)) and len(d) < 3,
        len(core) >= 16 and bool(re.fullmatch("[A-Za-z0-9+/=_-]+", core)) and bool(d) and not decimal,
        len(core) >= 16 and bool(re.fullmatch("[0-9a-fA-F]+", core)) and not decimal,
        *(bool(c.search(context)) for c in CUES),
    ]


N_FEATURES = len(features("0", "", "", ""))


@dataclass
class Nodes:
    """Nodes of several texts: places, rows of features, edges (node, node) by kind."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    seen: np.ndarray
    edges: tuple[np.ndarray, np.ndarray, np.ndarray]


def _form(token: str) -> str:
    d = _digits(token)
    return d[-7:] if len(d) >= 7 and "@" not in token and not re.search("[A-Za-z]", token) else token.strip(_EDGE).lower()


def _shape(token: str) -> str | None:
    """What similar tokens have in common; None for tokens that are like too many others."""
    core = token.strip(_EDGE)
    if len(mail := _AT.split(core)) > 1:
        return "@" + mail[-1].lower()
    if core.isdecimal():
        return f"{len(core)}" if len(core) >= 7 else None
    if core.count(".") == 3 and core.replace(".", "").isdecimal():
        return "dotted"
    if re.fullmatch("[0-9-]+", core) and len(core) >= 7:
        return re.sub("[0-9]", "0", core)
    return f"hex{len(core)}" if len(core) >= 16 and re.fullmatch("[0-9a-fA-F]+", core) else None


def marked_tokens(text: str) -> list[tuple[int, int]]:
    """Bounds of the runs without white space that hold a digit, an at sign, or "at" in
    brackets."""
    out, last = [], 0
    for m in _REST.finditer(text):
        a = m.start()
        while a > last and not text[a - 1].isspace():
            a -= 1
        last = m.end()
        out.append((a, last))
    return out


def nodes(texts: list[str]) -> Nodes:
    text, start, end, seen = [], [], [], []
    edges: tuple[list, list, list] = ([], [], [])
    for t, s in enumerate(texts):
        found = marked_tokens(s)
        forms: dict[str, int] = {}
        shapes: dict[str, int] = {}
        for i, (a, b) in enumerate(found):
            n = len(text)
            before = s[slice(*found[i - 1])] if i and a - found[i - 1][1] == 1 else ""
            after = s[slice(*found[i + 1])] if i + 1 < len(found) and found[i + 1][0] - b == 1 else ""
            token = s[a:b]
            text.append(t)
            start.append(a)
            end.append(b)
            seen.append(features(token, s[max(0, a - LOOK_BACK) : a], before, after))
            if before:
                edges[CHAIN].append((n - 1, n))
            form, shape = _form(token), _shape(token)
            if len(form) >= 5:
                if form in forms:
                    edges[SAME].append((forms[form], n))
                forms[form] = n
            if shape is not None:
                if shape in shapes and forms.get(form) == n and (shapes[shape], n) not in edges[SAME][-1:]:
                    edges[SIMILAR].append((shapes[shape], n))
                shapes[shape] = n
    pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return Nodes(np.array(text, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(seen, float).reshape(-1, N_FEATURES), tuple(map(pairs, edges)))


def base_labels(x: Nodes, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each node by the spans (kind, start, end) that it overlaps (0: outside). Where
    several kinds overlap it, the first kind holds."""
    y = np.zeros(len(x.text), np.int64)
    bounds = np.searchsorted(x.text, np.arange(len(spans) + 1))
    for t, own in enumerate(spans):
        a, b = bounds[t], bounds[t + 1]
        for k, s, e in sorted(own, reverse=True):
            # Nodes of a text are in order and do not overlap.
            y[a + np.searchsorted(x.end[a:b], s, "right") : a + np.searchsorted(x.start[a:b], e, "left")] = k + 1
    return y


@dataclass
class Field:
    own: np.ndarray  # [features, labels]
    chain: np.ndarray  # [label, label of the next node]
    same: np.ndarray  # [label]: weight of agreement
    similar: np.ndarray

    def marginals(self, x: Nodes) -> np.ndarray:
        """Loopy sum-product of all texts at once. A text's messages stop as soon as they have
        settled, so they do not depend on the other texts; the damping grows with the rounds,
        so every text settles."""
        own = x.seen @ self.own
        kinds = [(x.edges[CHAIN], self.chain), (x.edges[SAME], np.diag(self.same)), (x.edges[SIMILAR], np.diag(self.similar))]
        if not any(len(e) for e, _ in kinds):
            return _shares(own)
        # Each edge sends both ways; weights by kind and direction.
        source = np.concatenate([e[:, i] for e, _ in kinds for i in (0, 1)])
        target = np.concatenate([e[:, 1 - i] for e, _ in kinds for i in (0, 1)])
        kind = np.repeat(np.arange(6), [len(e) for e, _ in kinds for _ in (0, 1)])
        back = np.concatenate([np.arange(len(e)) + at + (len(e) if i == 0 else -len(e)) for at, e, i in _starts(kinds)])
        weights = [np.exp(w if i == 0 else w.T) for _, w in kinds for i in (0, 1)]
        sent = np.full((len(source), LABELS), -np.log(LABELS))
        live, step, rounds = np.arange(len(source)), 0.5, 0
        while len(live):
            known = own[source[live]] + _sums(target, sent, len(own))[source[live]] - sent[back[live]]
            known = np.exp(known - known.max(1, keepdims=True))
            new = np.empty_like(known)
            for k, w in enumerate(weights):
                at = kind[live] == k
                new[at] = known[at] @ w
            change = step * (np.log(new / new.sum(1, keepdims=True) + 1e-30) - sent[live])
            sent[live] += change
            moving = np.zeros(int(x.text[-1]) + 1, bool)
            moving[x.text[target[live[np.abs(change).max(1) > SETTLED]]]] = True
            live = live[moving[x.text[target[live]]]]
            rounds += 1
            step *= 0.5 if rounds % 50 == 0 else 1.0
        return _shares(own + _sums(target, sent, len(own)))


def _shares(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)


def _starts(kinds: list) -> Iterator[tuple[int, np.ndarray, int]]:
    at = 0
    for e, _ in kinds:
        for i in (0, 1):
            yield at, e, i
            at += len(e)


def learn(x: Nodes, y: np.ndarray, counts: np.ndarray, steps: int = 2000, rate: float = 0.1, decay: float = 2e-5) -> Field:
    """Weights of greatest pseudo-likelihood: each node that counts, given its neighbours'
    labels. Gaussian priors around zero; steps are scaled by the gradients' running moments."""
    n, size = max(int(counts.sum()), 1), len(y)
    hot = np.eye(LABELS)[y] * counts[:, None]
    beside = lambda k, i: _sums(x.edges[k][:, i], hot[x.edges[k][:, 1 - i]], size)
    left, right = beside(CHAIN, 1), beside(CHAIN, 0)
    around = [beside(k, 0) + beside(k, 1) for k in (SAME, SIMILAR)]
    shapes = [(N_FEATURES, LABELS), (LABELS, LABELS), (LABELS,), (LABELS,)]
    weights, first, second = ([np.zeros(s) for s in shapes] for _ in range(3))
    for t in range(1, steps + 1):
        own, chain, same, similar = weights
        score = x.seen @ own + left @ chain + right @ chain.T + around[0] * same + around[1] * similar
        miss = hot - _shares(score) * counts[:, None]
        slopes = [x.seen.T @ miss, left.T @ miss + miss.T @ right, (around[0] * miss).sum(0), (around[1] * miss).sum(0)]
        for k, slope in enumerate(slopes):
            slope = slope / n - decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            weights[k] = weights[k] + rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Field(*weights)


def secrets(text: str) -> list[tuple[int, int, int]]:
    """Plain secrets, as labels to learn from: long values right behind their cue."""
    out = []
    for a, b in marked_tokens(text):
        if b - a >= 8 and CUES[SECRET].search(text[max(0, a - LOOK_BACK) : a]):
            out.append((SECRET, a, b))
    return out


def near_misses(x: Nodes, y: np.ndarray) -> np.ndarray:
    """Nodes without a label that look like a kind which their text holds."""
    dotted, quad, long, checked = (x.seen[:, i] > 0 for i in (4, 5, 8, 9))
    held = np.zeros((int(x.text[-1]) + 1 if len(x.text) else 0, LABELS), bool)
    held[x.text, y] = True
    looks = np.where(dotted & ~quad, 2, np.where(long & ~checked, 3, 0))
    return (y == 0) & (looks > 0) & held[x.text, looks]


def mentions(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """text with further mentions of some of its entities behind it, and all spans. A text
    without a card may get several numbers that look like one, and one without an address
    several dotted ones, which are outside."""
    rng, out = random.Random(zlib.crc32(text.encode())), list(spans)
    kinds = {k for k, _, _ in spans}
    for k in {1, 2} - kinds:
        if rng.random() < 0.5:
            size = rng.randint(16, 19)
            few = [".".join(str(rng.randint(256, 999)) for _ in range(4)) if k == 1 else str(rng.randrange(10 ** (size - 1), 10**size)) for _ in range(rng.randint(1, 3))]
            few = [x[:-1] + str((int(x[-1]) + 1) % 10) if k == 2 and luhn(x) else x for x in few]
            text += "".join(f"\n and also {rng.choice(few)}" for _ in range(3))
    for k, a, b in spans:
        how, said = rng.randrange(6), text[a:b]
        if how > 3:
            continue
        if how in (1, 2) and (at := [i for i, c in enumerate(said) if "0" <= c <= "9"]):
            i = rng.choice(at)
            said = said[:i] + str((int(said[i]) + rng.randint(1, 9)) % 10) + said[i + 1 :]
        elif how == 3:
            said = said.replace("@", "(at)") if k == 0 else said.partition(" ")[2] or said if k == 3 else said
        text += "\n and also "
        out.append((k, len(text), len(text) + len(said)))
        text += said
    return text + "\n", out


def _marked(column) -> list[int]:
    """Rows whose text may have a node."""
    raw, off = views(column)
    at = np.flatnonzero(_MARKS[raw[off[0] : off[-1]]]) + off[0]
    rows = np.searchsorted(off, at, "right") - 1
    written = pc.fill_null(pc.match_substring_regex(column, r"(?i)[(\[]at[)\]]"), False).to_numpy(zero_copy_only=False)
    return np.union1d(rows, np.flatnonzero(written)).tolist()


def examples(texts: list[str]) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """Nodes of texts with further mentions, their labels, and which of them count."""
    made = [mentions(t, base_spans(t) + secrets(t)) for t in texts]
    x = nodes([t for t, _ in made])
    y = base_labels(x, [s for _, s in made])
    return x, y, ~near_misses(x, y)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from at most `sample` distinct texts with a digit or an at sign."""
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30))
    marked = docs.filter(F.col("text").rlike("[0-9@]")).select("text", draw.alias("draw"))
    # About twice the sample of the distinct texts passes the hash, whatever the size of the
    # table and of its groups of copies. Nodes, not texts, are kept.
    n = marked.agg(F.approx_count_distinct("draw")).first()[0]
    if not n:
        return None
    few = marked.filter(F.col("draw") < int(min(1, (2 * sample + 50) / n) * (1 << 30))).groupBy("draw").agg(F.min("text").alias("text")).orderBy("draw").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, counts = examples(batch.column(0).to_pylist())
            parts = (x.text, "i8"), (x.seen, "u1"), (y, "i8"), (counts, "u1"), *((e, "i8") for e in x.edges)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, t).tobytes()], pa.binary()) for v, t in parts], names=["text", "seen", "y", "counts", "chain", "same", "similar"])

    got = few.select("text").mapInArrow(run, "text binary, seen binary, y binary, counts binary, chain binary, same binary, similar binary").collect()
    text, seen, y, counts, edges, n = [], [], [], [], ([], [], []), 0
    for r in got:
        text.append(np.frombuffer(r["text"], "i8") + (text[-1][-1] + 1 if text and len(text[-1]) else 0))
        y.append(np.frombuffer(r["y"], "i8"))
        seen.append(np.frombuffer(r["seen"], "u1").reshape(-1, N_FEATURES))
        counts.append(np.frombuffer(r["counts"], "u1") > 0)
        for k, name in enumerate(("chain", "same", "similar")):
            edges[k].append(np.frombuffer(r[name], "i8").reshape(-1, 2) + n)
        n += len(y[-1])
    if not n:
        return None
    none = np.zeros(0, np.int64)
    return learn(Nodes(np.concatenate(text), none, none, np.concatenate(seen).astype(float), tuple(map(np.concatenate, edges))), np.concatenate(y), np.concatenate(counts))


#: Nodes labelled at once (memory only); a text with more stands alone.
NODES = 20_000


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field finds outside the base spans: runs of neighbouring nodes with one
    sure label, without the punctuation around them. Kind SECRET marks secrets."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    x = nodes(texts)
    if not len(x.text):
        return out
    p = field.marginals(x)
    label = np.where((p.argmax(1) > 0) & (p.max(1) >= SURE), p.argmax(1), 0)
    covered = base_labels(x, base) > 0
    digits = lambda i: len(_digits(texts[x.text[i]][x.start[i] : x.end[i]]))
    i = 0
    while i < len(label):
        j = i + 1
        if label[i] and not covered[i]:
            size = digits(i)
            # Pieces of one number; a card has at most 19 digits, other kinds are one token.
            while j < len(label) and label[j] == label[i] in (3, 4) and not covered[j] and x.text[j] == x.text[i] and x.start[j] - x.end[j - 1] == 1 and size + digits(j) <= (19 if label[i] == 3 else 15):
                size += digits(j)
                j += 1
            t, a, b = int(x.text[i]), int(x.start[i]), int(x.end[j - 1])
            s = texts[t]
            while a < b and not (s[a].isalnum() or s[a] in "+("):
                a += 1
            while b > a and not s[b - 1].isalnum():
                b -= 1
            if b - a >= 5:
                out[t].append((int(label[i]) - 1, a, b))
        i = j
    return out


def find(docs: DataFrame, field: Field | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs with n_email, n_ip, n_card, n_phone (base spans), base (their
    list), spans (all of the four kinds), n_added (those that the field added), n_secret and
    secrets (their list), n_found (all spans and secrets)."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = [f"n_{k}" for k in KINDS]
    schema = with_fields(docs.select(*keep), ", ".join(f"{c} long" for c in counts) + ", base string, spans string, n_added long, n_secret long, secrets string, n_found long")
    held = spark.sparkContext.broadcast(field)
    source = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            column = batch.column(len(keep))
            size = len(column)
            n, more_n, secret_n = np.zeros((len(KINDS), size), np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            base_text, all_text, secret_text = [""] * size, [""] * size, [""] * size
            rows = _marked(column) if size else []
            at = 0
            while at < len(rows):
                # As many rows as have about NODES nodes.
                part, texts, weight = [], [], 0
                while at < len(rows) and weight < 16 * NODES:
                    texts.append(column[rows[at]].as_py() or "")
                    weight += len(texts[-1])
                    part.append(rows[at])
                    at += 1
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model) if model else [[] for _ in texts]
                for i, own, added in zip(part, base, more, strict=True):
                    for k, _, _ in own:
                        n[k, i] += 1
                    hidden = [x for x in added if x[0] == SECRET]
                    added = [x for x in added if x[0] != SECRET]
                    more_n[i], secret_n[i] = len(added), len(hidden)
                    base_text[i], all_text[i], secret_text[i] = joined(own), joined(own + added), ",".join(f"{a}:{b}" for _, a, b in hidden)
            columns = [*(pa.array(c) for c in n), pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), pa.array(more_n), pa.array(secret_n), pa.array(secret_text, pa.string()), pa.array(n.sum(0) + more_n + secret_n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the
    first stands."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{(*KINDS, 'secret')[k]}>"]
            at = b
    return "".join(out) + text[at:]


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added", "n_secret", "secrets", "n_found")
