"""Secrets: fixed patterns, and a character convolutional network over every candidate and what stands around it.

The patterns find assignments to names such as token or api_key, access keys and long hexadecimal runs, each kind for
itself, leftmost and non-overlapping.  Candidates are those matches and, outside of them, every maximal run of eight
or more of `[A-Za-z0-9+/_.=-]` that holds a digit, or letters of both cases beyond a leading capital.  The network
reads the candidate whole, LEFT characters before and RIGHT after it: a convolution of five characters, rectified and
pooled over four regions, then two dense layers.  Pooling runs over ragged segments, so a candidate may be of any length.

It is trained in numpy on labelled findings written here: keys, passwords, signed tokens and connection strings in
prose and in settings, against dates, versions, hosts, paths, card and phone numbers, identifiers and addresses.  A part that is not
learned from gives an isotonic calibration, and for each shape of candidate the greatest threshold that still finds
`recall` of its secrets.  Candidates that reach it become spans of the kind `other`; pattern matches stay whatever the
network says, and those below their threshold are counted as doubtful.

Edge cases: null and empty texts have no spans; repeated rows are searched each for itself; a null doc_id is kept;
spans that start together come in the order of kinds; an empty table gives an empty result; texts of any length are
searched whole, in time linear in their length; further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slices
from tidemark.llm.quality import isotonic

KINDS = ("assign", "access", "hex", "other")
LEFT, NEAR, RIGHT, WIDTH = 24, 10, 8, 5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
_PLAIN = re.compile(r"[A-Z]?[a-z]+[.=-]*|[A-Z]+[.=-]*|[.=_/+-]+")

Span = tuple[int, int]


def base_spans(text: str, runs: list[tuple[int, str]]) -> dict[str, list[Span]]:
    """Pattern matches by kind, as (start, end) in code points.  Access keys and hexadecimal runs lie within runs."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    low = text.lower()
    if any(n in low for n in _NAMES):
        found["assign"] = [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    for kind, pattern, least in (("access", _ACCESS, 16), ("hex", _HEX, 32)):
        found[kind] = [(at + m.start(), at + m.end()) for at, run in runs if len(run) >= least for m in pattern.finditer(run) if len(m[0]) >= least]
    return found


def candidates(text: str) -> tuple[dict[str, list[Span]], list[Span]]:
    """Pattern matches, and the other candidates: runs that touch none of them."""
    runs = [(m.start(), m[0]) for m in _RUN.finditer(text)]
    found = base_spans(text, runs)
    taken = sorted(s for v in found.values() for s in v)
    other, i = [], 0
    for at, run in runs:
        end = at + len(run.rstrip(".="))
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        if end - at >= 8 and (i == len(taken) or taken[i][0] >= end) and not _PLAIN.fullmatch(run):
            other.append((at, end))
    return found, other


def digest(spans: dict[str, list[Span]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, order[k], b, k) for k in KINDS for a, b in spans[k]))


#: Codes of characters: printable ASCII by itself with digits as one, then line ends, all beyond ASCII, and nothing.
N_CODES, _DIGIT, _LINE, _BEYOND, _NOTHING = 99, 16, 95, 96, 97


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((c >= 32) & (c < 127), c - 32, np.where(c < 32, _LINE, _BEYOND))
    out[(c >= 48) & (c < 58)] = _DIGIT
    return out


def shape(word: str) -> int:
    """0 digits and hexadecimal, 1 letters of both cases with digits, 2 with dots, 3 others."""
    if re.fullmatch(r"[0-9a-fA-F-]+", word):
        return 0
    if "." in word:
        return 2
    return 1 if re.search("[a-z]", word) and re.search("[A-Z]", word) and re.search("[0-9]", word) else 3


SHAPES = 4
#: Pooled regions: all that stands before, the last NEAR characters of it, the candidate, what follows.
REGIONS = 4


@dataclass
class Layout:
    """Segments of several candidates in one array of codes, with the regions' places and what a length says."""

    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    facts: np.ndarray


def layout(pieces: list[tuple[str, str, str]]) -> Layout:
    """pieces: (before, candidate, after)."""
    parts, begin, end, facts, at = [], [], [], [], 0
    pad = np.full(WIDTH, _NOTHING)
    for before, word, after in pieces:
        a, w, b = codes(before[-LEFT:]), codes(word), codes(after[:RIGHT])
        parts += [pad, a, w, b, pad]
        s = at + WIDTH
        m, e = s + len(a), s + len(a) + len(w)
        begin.append((s - 1, max(s - 1, m - NEAR), m, e))
        end.append((max(m, s), max(m, s), e, e + len(b) + 1))
        at = e + len(b) + WIDTH
        n = len(word)
        facts.append((np.log(n) / 4, len(set(word)) / min(n, 64), sum(c.isdigit() for c in word) / n, sum(c.isupper() for c in word) / n))
    return Layout(np.concatenate(parts), np.array(begin), np.array(end), np.array(facts))


N_FACTS = 4


@dataclass
class Network:
    """Weights by name: filters (place, code, filter), bias, and two dense layers."""

    w: dict[str, np.ndarray]
    scores: np.ndarray = None
    chances: np.ndarray = None
    thresholds: np.ndarray = None

    @staticmethod
    def start(filters: int, hidden: int, rng: np.random.Generator) -> Network:
        n = (REGIONS + 1) * filters + N_FACTS
        return Network({"filters": rng.normal(0, 0.15, (WIDTH, N_CODES, filters)), "bias": np.zeros(filters), "dense": rng.normal(0, 1 / np.sqrt(n), (n, hidden)), "lift": np.zeros(hidden), "out": rng.normal(0, 1 / np.sqrt(hidden), hidden), "shift": np.zeros(1)})

    def forward(self, x: Layout) -> tuple:
        """Logits, and what the backward pass needs: rectified filters, pooled maxima and the layers' inputs."""
        n = len(x.codes)
        around = np.stack([np.clip(np.arange(n) + k - WIDTH // 2, 0, n - 1) for k in range(WIDTH)])
        seen = x.codes[around]
        z = self.w["bias"] + sum(self.w["filters"][k][seen[k]] for k in range(WIDTH))
        r = np.maximum(z, 0)
        bounds = np.stack([x.begin, x.end], axis=2)  # candidate, region, (begin, end)
        tops = [np.maximum.reduceat(r, bounds[:, g].ravel())[::2] for g in range(REGIONS)]
        size = (x.end[:, 2] - x.begin[:, 2])[:, None]
        mean = np.add.reduceat(r, bounds[:, 2].ravel())[::2] / size
        pooled = np.concatenate([*tops, mean, x.facts], axis=1)
        h = pooled @ self.w["dense"] + self.w["lift"]
        return np.maximum(h, 0) @ self.w["out"] + self.w["shift"][0], seen, r, tops, pooled, h

    def backward(self, x: Layout, slope: np.ndarray, seen: np.ndarray, r: np.ndarray, tops: list[np.ndarray], pooled: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        f = r.shape[1]
        dh = slope[:, None] * self.w["out"] * (h > 0)
        dp = dh @ self.w["dense"].T
        dr = np.zeros_like(r)
        for g in range(REGIONS):
            for i in range(len(slope)):
                a, b = x.begin[i, g], x.end[i, g]
                on = r[a:b] == tops[g][i]
                dr[a:b] += on * (dp[i, g * f : (g + 1) * f] / on.sum(axis=0))
                if g == 2:
                    dr[a:b] += dp[i, REGIONS * f : (REGIONS + 1) * f] / (b - a)
        dz = dr * (r > 0)
        filters = np.empty_like(self.w["filters"])
        for k in range(WIDTH):
            filters[k] = np.bincount((seen[k][:, None] * f + np.arange(f)).ravel(), weights=dz.ravel(), minlength=N_CODES * f).reshape(N_CODES, f)
        return {"filters": filters, "bias": dz.sum(axis=0), "dense": pooled.T @ dh, "lift": dh.sum(axis=0), "out": np.maximum(h, 0).T @ slope, "shift": np.array([slope.sum()])}

    def logits(self, pieces: list[tuple[str, str, str]], limit: int = 200_000) -> np.ndarray:
        """Logits of candidates of any length, in runs of about `limit` characters."""
        out, start, size = [np.empty(0)], 0, 0
        for i, p in enumerate(pieces):
            size += len(p[1]) + LEFT + RIGHT
            if size > limit or i == len(pieces) - 1:
                out.append(self.forward(layout(pieces[start : i + 1]))[0])
                start, size = i + 1, 0
        return np.concatenate(out)

    def chance(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        return np.interp(logits, self.scores, self.chances)

    def hits(self, words: list[str], logits: np.ndarray) -> np.ndarray:
        return logits >= self.thresholds[[shape(w) for w in words]] if words else np.empty(0, bool)


def labelled_findings(n: int = 6000, seed: int = 13) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label) of invented findings: 1 a secret, 0 not."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = "an en er in on re th ti es ou ha la de os ci ra que ión ent aux ée sch ung ein ter lich ver no ma pi so lu".split()

    def of(letters: str, a: int, b: int | None = None) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(a, b or a)))

    def mixed(a: int, b: int, letters: str = lower + upper + digits) -> str:
        return of(lower, 1) + of(upper, 1) + of(digits, 1) + of(letters, a - 3, b - 3)

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def prose(a: int = 2, b: int = 7) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))) + rng.choice(["", "", "", ".", ","])

    url = lower + upper + digits + "-_"
    secret = [
        lambda: of(lower, 2, 5) + rng.choice("_-") + rng.choice(["", "live_", "test_"]) + mixed(20, 40), lambda: mixed(24, 64, lower + upper + digits + "+/") + rng.choice(["", "=", "=="]), lambda: "eyJ" + of(url, 15, 40) + ".eyJ" + of(url, 20, 90) + "." + of(url, 30, 60),
        lambda: of("0123456789ABCDEF", 32, 64), lambda: rng.choice(["ASIA", "AROA", "AIza"]) + of(upper + digits, 16, 32), lambda: mixed(20, 48, url), lambda: of(digits + lower, 24, 40), lambda: of(upper + digits, 24, 40), lambda: of(digits, 6, 12) + "-" + mixed(24, 40),
    ]
    secret_names = "pwd pass passphrase credential credentials auth authorization bearer client_key private_key access_key signing_key secret_access DB_PASS AccountKey SharedAccessKey session_key webhook key jwt pat x-api-auth".split()
    guarded = [lambda: mixed(9, 16), lambda: word().capitalize().encode("ascii", "ignore").decode()[:8] + of(lower, 4) + of(digits, 2, 4), lambda: mixed(10, 18, lower + upper + digits + "_-+"), lambda: "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: of("0123456789abcdef", 16, 31)]
    benign = [
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}-{rng.choice(['beta', 'rc', 'alpha'])}.{rng.randint(1, 9)}", lambda: of(digits, 12, 19), lambda: "-".join(of(digits, 4) for _ in range(4)),
        lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: f"{of(lower, 3, 8)}{rng.randint(0, 999)}.{of(lower, 4, 9)}.{rng.choice(['com', 'org', 'net', 'example', 'io'])}", lambda: f"{of(lower, 3, 9)}.{of(lower, 4, 9)}{rng.randint(0, 99)}",
        lambda: f"www.{of(lower, 4, 9)}{rng.randint(0, 9)}.com/{of(lower, 3, 9)}/{rng.randint(1, 2030)}/{of(lower, 3, 9)}", lambda: f"/{of(lower, 3, 6)}/{of(lower, 3, 8)}{rng.randint(0, 9)}/{of(lower, 3, 8)}.{rng.choice(['txt', 'py', 'html', 'json'])}",
        lambda: "".join(x.capitalize() for x in (of(lower, 3, 7), of(lower, 3, 7), of(lower, 3, 7))), lambda: of(lower, 3, 6) + "".join(of(lower, 3, 7).capitalize() for _ in range(2)), lambda: "-".join(of(lower, 3, 7) for _ in range(2)) + f"-{rng.randint(1, 2030)}",
        lambda: "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"{rng.choice(['ISBN', 'No', 'RFC', 'ISO'])}-{of(digits, 4, 13)}", lambda: f"{of(upper, 2, 4)}-{of(digits, 4, 8)}", lambda: f"{rng.randint(1, 10**8)}.{of(digits, 2)}", lambda: f"{rng.randint(1900, 2030)}/{rng.randint(1900, 2030)}",
        lambda: f"{of(digits, 3)}-{of(digits, 3)}-{of(digits, 4)}", lambda: of(lower, 6, 12) + of(digits, 1, 4), lambda: f"{of(lower, 4, 9)}_{of(lower, 3, 9)}_{rng.randint(0, 999)}", lambda: "=" * rng.randint(2, 5) + of(lower, 3, 9) + of(digits, 1) + "=" * rng.randint(2, 5), lambda: of("x1", 8, 60) if rng.random() < 0.5 else "1" * rng.randint(8, 40),
        lambda: of(digits, 5, 8) + "T" + of(digits, 6) + "Z", lambda: of(upper, 2, 4) + of(lower, 5, 9), lambda: of(digits, 15, 17), lambda: f"{of(lower, 3, 6)}{rng.choice(['+', '='])}{rng.randint(0, 99999)}/{rng.randint(1, 99)}",
    ]
    plain_names = "id page date version build number phone tel fax call mail ref order card price width height host server see file path isbn issue year".split()
    out = []
    for i in range(n):
        before, after = prose() if rng.random() < 0.95 else "", rng.choice(["", "", "", "$$$ ", "###", "%%% "]) + prose()
        quote = rng.choice(["", "", '"', "'"])
        sign = rng.choice([" = ", "=", ": ", ":", " "])
        if i % 2:
            near = rng.random() < 0.55
            w = rng.choice(guarded)() if near and rng.random() < 0.45 else rng.choice(secret)()
            lead = f"{before} {rng.choice(secret_names)}{sign}{quote}" if near else f"{before} {quote}"
            if near and rng.random() < 0.1:
                lead, quote = f"{before} {of(lower, 4, 8)}://{of(lower, 3, 8)}:", "@"
        else:
            w = rng.choice(benign)()
            near = rng.random() < 0.4
            lead = f"{before} {rng.choice(plain_names)}{sign}{quote}" if near else f"{before} {quote}"
            if rng.random() < 0.08:
                lead, quote = f"{before} {of(lower, 3, 8)}{rng.choice(['@', '://'])}", ""
        if len(w) >= 8:
            out.append((lead[-LEFT:], w, f"{quote}{rng.choice([' ', ' ', ' ', ''])}{after}"[:RIGHT], i % 2))
    return out


def learn(findings: list[tuple[str, str, str, int]], filters: int = 16, hidden: int = 16, steps: int = 500, batch: int = 96, rate: float = 6e-3, recall: float = 0.95, seed: int = 31) -> Network:
    """Weights by Adam on three quarters of the findings; the rest calibrates and sets a threshold for each shape."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(findings))
    train, rest = order[: len(order) * 3 // 4], [findings[i] for i in order[len(order) * 3 // 4 :]]
    net = Network.start(filters, hidden, rng)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        some = [findings[i] for i in rng.choice(train, batch, replace=False)]
        x, y = layout([f[:3] for f in some]), np.array([f[3] for f in some], float)
        logits, *kept = net.forward(x)
        slope = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - y) / batch
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in net.backward(x, slope, *kept).items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g**2
            net.w[k] = net.w[k] - pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    logits, y, kind = net.logits([f[:3] for f in rest]), np.array([f[3] for f in rest], float), np.array([shape(f[1]) for f in rest])
    net.scores, net.chances = np.sort(logits), isotonic(logits, y, np.ones(len(y)))
    # The greatest score that leaves at least `recall` of a shape's secrets at or above it, but none that is likelier wrong than right.
    even = net.scores[min(int(np.searchsorted(net.chances, 0.5)), len(rest) - 1)]
    net.thresholds = np.array([max(even, np.sort(own)[int((1 - recall) * len(own))]) if len(own := logits[(kind == s) & (y == 1)]) else np.inf for s in range(SHAPES)])
    return net


def fit(recall: float = 0.95) -> Network:
    return learn(labelled_findings(), recall=recall)


def around(text: str, span: Span) -> tuple[str, str, str]:
    a, b = span
    return text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_candidates long, n_added long, n_doubtful long"


def find(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, pattern matches of each kind, base_spans, spans (with those that the network adds), candidates, added and doubtful ones.  One pass; nothing is shuffled."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches):
            texts = [t.decode("utf-8", "replace") for t in raw]
            found = [candidates(t) for t in texts]
            at = [(i, k, s) for i, (base, other) in enumerate(found) for k in KINDS for s in (base[k] or (other if k == "other" else []))]
            pieces = [around(texts[i], s) for i, _, s in at]
            yes = net.hits([p[1] for p in pieces], net.logits(pieces))
            added: list[list[Span]] = [[] for _ in texts]
            doubtful = [0] * len(texts)
            for (i, k, s), hit in zip(at, yes.tolist(), strict=True):
                if k == "other" and hit:
                    added[i].append(s)
                elif k != "other" and not hit:
                    doubtful[i] += 1
            rows = [(*(len(base[k]) for k in KINDS[:3]), digest(base), digest(base | {"other": added[i]}), sum(map(len, base.values())) + len(other), len(added[i]), doubtful[i]) for i, (base, other) in enumerate(found)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in FOUND.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(search, FOUND)
