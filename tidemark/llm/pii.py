"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers, each kind for itself, leftmost and
non-overlapping.  The field labels the words of a document that hold a digit or an at sign (all others are outside any
entity).  Neighbouring words share chain potentials; distant occurrences of the same or a similar word share skip
potentials, each occurrence with the next, so that the graph stays linear in the text.  Similar words are found by key: equal after
case and punctuation are dropped (three digits at least), the same last seven digits, or the same name before an at
sign.  Words inside pattern matches are evidence; loopy sum-product passes it on; words whose marginal for a kind reaches
`sure` become further spans of that kind, and neighbouring ones are one span while their digits fit the kind.

Weights maximise the pseudo-likelihood on labelled documents that are written here, with forms that the patterns
miss (phone numbers without a plus sign, cards that stand side by side or have other separators, addresses without a dot) and
with numbers that are no personal data (years, versions, prices, dates, hexadecimal keys, numbers that fail Luhn).

Edge cases: null and empty texts have no spans; repeated rows are searched each for itself; a null doc_id is kept;
of equally likely kinds the first listed wins; further columns are ignored; an empty table gives an empty result; texts of any
length are searched whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_ANY = re.compile(r"[0-9@]")
_EDGES = "\"'[]{}<>,;:!?."


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Pattern matches by kind, as (start, end) in code points."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not _ANY.search(text):
        return found
    found["email"] = _emails(text)
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def digest(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


@dataclass
class Graph:
    """Marked words of a document: places, features, known kinds (0 none) and links."""

    places: list[Span]
    features: np.ndarray
    known: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


#: Words that announce a kind, in four languages (fixed values).
CUES = {
    "email": frozenset("mail email e-mail correo courriel address write contact".split()),
    "ip": frozenset("ip host server address login gateway router".split()),
    "card": frozenset("card visa mastercard carte karte tarjeta credit payment paid".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell ring téléphone telefon teléfono móvil appelez anrufen".split()),
}
_PHONE_PART = re.compile(r"\(?[0-9]{2,4}\)?(?:[-./][0-9]{3,4})*")
_YEAR = re.compile(r"(?:19|20)[0-9]{2}")
#: Most digits of a span of several words.
_MOST = {"email": 0, "ip": 0, "card": 19, "phone": 15}
N_FEATURES = 28


def _features(word: str, before: list[str]) -> list[float]:
    digits = "".join(c for c in word if c in "0123456789")
    n, letters, parts = len(digits), sum(c.isalpha() for c in word), word.split(".")
    name, at, host = word.partition("@")
    return [
        1.0, at != "", word[0] == "+", word[0] == "(", word.count(".") == 3, "." in word, "-" in word[1:], "=" in word or '"' in word,
        n <= 2, 3 <= n <= 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 15, n >= 16, letters > 0, letters > n, len(word) > 24,
        not letters and 13 <= n <= 19 and _luhn(digits), len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts),
        _PHONE_PART.fullmatch(word) is not None, _YEAR.fullmatch(word) is not None, bool(name and at and host and host[0].isalnum() and "@" not in host), 7 <= n <= 12 and not letters and "-" in word, not letters and word.count(".") == 1,
        *(any(w in CUES[k] for w in before) for k in KINDS),
    ]


def graph(text: str, spans: dict[str, list[Span]]) -> Graph:
    places, words, before = [], [], []
    last_end, last_cue = 0, []
    for m in _MARKED.finditer(text):
        word = m[0].strip(_EDGES) or m[0]
        start = m.start() + m[0].find(word)
        between = text[max(last_end, m.start() - 60) : m.start()].lower().split()[-3:]
        last_cue = [w.strip(_EDGES) for w in between] or last_cue  # neighbours of one entity share what announces it
        places.append((start, start + len(word)))
        words.append(word)
        before.append(last_cue)
        last_end = m.end()
    known = np.zeros(len(words), np.int64)
    for k, kind in enumerate(KINDS, 1):
        i = 0
        for a, b in sorted(spans[kind]):
            while i < len(places) and places[i][1] <= a:
                i += 1
            j = i
            while j < len(places) and places[j][0] < b:
                known[j] = k
                j += 1
    near = [i for i in range(1, len(words)) if places[i][0] - places[i - 1][1] <= 3]
    last: dict[tuple, int] = {}
    skip = set()
    for i, word in enumerate(words):
        key = "".join(c for c in word.lower() if c.isalnum() or c == "@")
        digits = "".join(c for c in word if c in "0123456789")
        keys = [("same", key)] if len(digits) >= 3 or "@" in key else []
        keys += [("end", digits[-7:])] if len(digits) >= 7 else []
        keys += [("name", key.partition("@")[0])] if "@" in key[1:] else []
        for k in keys:
            if k in last:
                skip.add((last[k], i))
            last[k] = i
    skip = sorted(skip)
    features = np.array([_features(w, b) for w, b in zip(words, before, strict=True)], float).reshape(-1, N_FEATURES)
    return Graph(places, features, known, np.array([(i - 1, i) for i in near], np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))


@dataclass
class Field:
    """Weights: features to labels, and label to label along chain and skip links."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int = 12) -> np.ndarray:
        """Loopy sum-product in log space; words inside pattern matches are clamped to their kind."""
        n = len(g.places)
        own = g.features @ self.unary
        clamped = g.known > 0
        own[clamped] = -50.0
        own[clamped, g.known[clamped]] = 0.0
        links = np.concatenate([g.chain, g.skip])
        if not len(links):
            return _softmax(own)
        table = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), 5, 5)), np.broadcast_to(self.skip, (len(g.skip), 5, 5))])
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        messages = np.zeros((len(source), 5))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, target, messages)
            out = (belief[source] - messages[back])[:, :, None] + table
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - messages).max() < 1e-6:
                break
            messages = 0.5 * messages + 0.5 * new
        belief = own.copy()
        np.add.at(belief, target, messages)
        assert belief.shape == (n, 5)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sums(n: int, links: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How often each label stands at the other end of a node's links."""
    out, one = np.zeros((n, 5)), np.eye(5)
    if len(links):
        np.add.at(out, links[:, 0], one[labels[links[:, 1]]])
        np.add.at(out, links[:, 1], one[labels[links[:, 0]]])
    return out


def learn(graphs: list[Graph], steps: int = 300, rate: float = 0.1, ridge: float = 1e-2, agreement: float = 3.0) -> Field:
    """Weights of greatest penalised pseudo-likelihood, by gradient ascent with adaptive steps.

    The penalty pulls skip weights to `agreement` for equal labels, since few documents repeat an entity, and all
    others to 0.
    """
    prior = np.zeros((N_FEATURES + 10, 5))
    prior[N_FEATURES + 5 :] = agreement * np.eye(5)
    if not graphs:
        return Field(prior[:N_FEATURES], prior[N_FEATURES : N_FEATURES + 5], prior[N_FEATURES + 5 :])
    x = np.concatenate([np.hstack([g.features, _sums(len(g.places), g.chain, g.known), _sums(len(g.places), g.skip, g.known)]) for g in graphs])
    y = np.eye(5)[np.concatenate([g.known for g in graphs])]
    w, first, second = prior.copy(), 0.0, 0.0
    for t in range(1, steps + 1):
        slope = x.T @ (y - _softmax(x @ w)) / len(x) - ridge * (w - prior) / 10
        for a in (slice(N_FEATURES, N_FEATURES + 5), slice(N_FEATURES + 5, None)):
            slope[a] = (slope[a] + slope[a].T) / 2  # a link has no direction
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Field(w[:N_FEATURES], w[N_FEATURES : N_FEATURES + 5], w[N_FEATURES + 5 :])


def added_spans(text: str, spans: dict[str, list[Span]], field: Field, sure: float) -> dict[str, list[Span]]:
    """Spans that the field adds to the pattern matches."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    g = graph(text, spans)
    if not len(g.places):
        return out
    p = field.marginals(g)
    last = (-2, 0)
    for i in np.flatnonzero((g.known == 0) & (p[:, 1:].max(axis=1) >= sure)).tolist():
        k = int(p[i, 1:].argmax())
        a, b = g.places[i]
        some = out[KINDS[k]]
        if last == (i - 1, k) and a - some[-1][1] <= 3 and sum(c.isdigit() for c in text[some[-1][0] : b]) <= _MOST[KINDS[k]]:
            some[-1] = (some[-1][0], b)
        else:
            some.append((a, b))
        last = (i, k)
    return out


def labelled_documents(n: int = 800, seed: int = 4) -> list[tuple[str, dict[str, list[Span]]]]:
    """Texts with the spans of all their personal data, whether the patterns find them or not."""
    rng = random.Random(seed)
    plain = "the river and a stone in that window of market garden letter was here le jardin et la fenêtre der Garten und das Fenster el jardín y la ventana".split()
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(size: int = 16) -> str:
        body = rng.choice("345") + number(size - 2)
        return next(body + c for c in "0123456789" if _luhn(body + c))

    def no_card() -> str:
        return next(x for x in iter(lambda: number(16), "") if not _luhn(x))

    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    group = lambda x, mark: mark.join(x[i : i + 4] for i in range(0, len(x), 4))
    local = lambda: rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {}-{}"]).format(number(3), number(3), number(4))
    kinds = {
        "email": [lambda: f"{name()}.{number(2)}@{name()}.example.com"] * 2 + [lambda: f"{name()}@{name()}.org", lambda: f"{name()}@localhost", lambda: f"{name()}{number(2)}@{name()}"],
        "ip": [lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))],
        "card": [card, lambda: group(card(), " "), lambda: group(card(), "."), lambda: group(card(), "/"), lambda: card(15)],
        "phone": [lambda: f"+{rng.randint(1, 99)} {local()}"] * 2 + [local] * 3,
    }
    others = [lambda: f"20{number(2)}", lambda: f"19{number(2)}", lambda: f"version {number(1)}.{number(1)}", lambda: f"{number(2)}.{number(2)}", lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}", lambda: number(rng.randint(1, 3)), no_card, lambda: number(8),
              lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"{rng.randint(1, 23)}:{number(2)}", lambda: f"item {number(5)}", lambda: f"1.{number(1)}.{number(2)}", lambda: f"a{number(2)}b"]
    out = []
    for _ in range(n):
        parts: list[tuple[str, str | None]] = []
        for _ in range(rng.randint(1, 7)):
            parts += [(rng.choice(plain), None) for _ in range(rng.randint(2, 9))]
            kind = rng.choice([*KINDS, None, None, None])
            if kind is None:
                parts.append((rng.choice(others)(), None))
                continue
            value = rng.choice(kinds[kind])()
            if rng.random() < 0.4:
                parts.append((rng.choice(sorted(CUES[kind])) + rng.choice(["", ":"]), None))
            parts.append((value, kind))
            if rng.random() < 0.3:  # repeated later, a phone number without its country
                parts += [(rng.choice(plain), None) for _ in range(rng.choice([0, 0, 3, 12]))]
                parts.append((value.split(" ", 1)[1] if value[0] == "+" else value, kind))
        text, spans = "", {k: [] for k in KINDS}
        for part, kind in parts:
            if kind:
                spans[kind].append((len(text), len(text) + len(part)))
            text += part + rng.choice([" "] * 8 + [", ", ". ", "\n"])
        out.append((text, spans))
    return out


def fit(documents: list[tuple[str, dict[str, list[Span]]]] | None = None) -> Field:
    """Learn from labelled documents, by default those written here."""
    return learn([g for g in (graph(text, spans) for text, spans in (documents or labelled_documents())) if len(g.places)])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_spans long, n_added long"


def find(docs: DataFrame, field: Field, sure: float = 0.9) -> DataFrame:
    """doc_id, pattern matches of each kind, base_spans, spans (with those that the field adds), their number and how many the field added."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                spans = base_spans(text)
                more = added_spans(text, spans, field, sure)
                rows.append((*(len(spans[k]) for k in KINDS), digest(spans), digest({k: spans[k] + more[k] for k in KINDS}), sum(len(spans[k]) + len(more[k]) for k in KINDS), sum(map(len, more.values()))))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            names = [x.split()[0] for x in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(search, FOUND)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
