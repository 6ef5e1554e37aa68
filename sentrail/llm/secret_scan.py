"""Secret scans: patterns first, then a character convolutional network over every candidate in its context.

A candidate is a longest run of at least CANDIDATE characters that keys are written in, with a
digit among them. The network sees the whole run and CONTEXT characters on both sides: two
convolutions over embedded characters, the largest value of each filter before, inside and
after the run and its mean inside, one hidden layer. It is trained in numpy on a bounded table of
labelled findings; a logistic calibration and the threshold come from rows that it was not
trained on, the threshold as the greatest that still finds RECALL of their secrets.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

CANDIDATE, CONTEXT = 16, 32
MAX_TRAINING = 6000
RECALL = 0.95
EMBED, FILTERS, WIDTH, HIDDEN = 8, 20, 5, 24
HALO = WIDTH - 1  # of two convolutions
#: Positions that one numpy step of scoring takes; a longer run goes through several.
BLOCK = 1 << 14

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the longest runs, of which shorter ones would be dropped
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}")
KINDS = ("assign", "access", "hex", "model")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """What the patterns find, in order of start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text) if any("0" <= c <= "9" for c in m.group())]


def listed(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# the network -----------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """A class of each character: printable ASCII apart, other white space, and all the rest as one."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((x >= 32) & (x < 127), x - 30, np.where(x < 32, 1, 97)).astype(np.int32)


CLASSES = 98  # 0 is no character


def windows(text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[np.ndarray, int, int]]:
    """For each span its characters with CONTEXT around them, and where the span lies in these."""
    out = []
    for a, b in spans:
        start = max(0, a - CONTEXT)
        out.append((codes(text[start : b + CONTEXT]), a - start, b - start))
    return out


def stacked(x: np.ndarray) -> np.ndarray:
    """Each position's WIDTH neighbours side by side, zeros beyond the ends; the positions are the last axis but one."""
    half = WIDTH // 2
    padded = np.zeros((*x.shape[:-2], x.shape[-2] + 2 * half, x.shape[-1]), x.dtype)
    padded[..., half:-half, :] = x
    return np.concatenate([padded[..., k : k + x.shape[-2], :] for k in range(WIDTH)], -1)


def unstacked(g: np.ndarray, channels: int) -> np.ndarray:
    """The gradient of ``stacked``."""
    half, n = WIDTH // 2, g.shape[-2]
    out = np.zeros((*g.shape[:-2], n + 2 * half, channels), g.dtype)
    for k in range(WIDTH):
        out[..., k : k + n, :] += g[..., k * channels : (k + 1) * channels]
    return out[..., half:-half, :]


class SecretNet:
    """The weights by name, the calibration ``scale`` and ``shift``, and ``threshold`` on the calibrated probability."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        c = EMBED + 3
        init = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / np.prod(shape[:-1]))).astype(np.float32)
        self.w = {
            "embed": (rng.standard_normal((CLASSES, EMBED)) * 0.5).astype(np.float32),
            "conv1": init(WIDTH * c, FILTERS), "bias1": np.zeros(FILTERS, np.float32),
            "conv2": init(WIDTH * FILTERS, FILTERS), "bias2": np.zeros(FILTERS, np.float32),
            "dense": init(4 * FILTERS, HIDDEN), "bias3": np.zeros(HIDDEN, np.float32),
            "out": init(HIDDEN, 1), "bias4": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _inputs(self, ids: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Embedded characters and which of the three regions they are in; nothing where there is no character (region -1)."""
        x = np.concatenate([self.w["embed"][ids], np.eye(4, 3, dtype=np.float32)[region]], -1)
        return x * (region >= 0)[..., None]

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.w["dense"] + self.w["bias3"], 0)
        return hidden, (hidden @ self.w["out"] + self.w["bias4"])[:, 0]

    def logits(self, items: Sequence[tuple[np.ndarray, int, int]]) -> np.ndarray:
        """One number for each window, over characters laid end to end, so that a window of any length fits in bounded steps."""
        n = len(items)
        if not n:
            return np.zeros(0, np.float32)
        gap = np.zeros(HALO, np.int32)
        ids = np.concatenate([part for chars, _, _ in items for part in (chars, gap)])
        lengths = np.array([(a, b - a, len(chars) - b, HALO) for chars, a, b in items])
        part = np.repeat(np.tile(np.array([0, 1, 2, -1], np.int8), n), lengths.ravel())
        place = np.repeat(np.arange(n, dtype=np.int32), lengths.sum(1)) * 3 + part
        top, total = np.zeros((3 * n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
        for a in range(0, len(ids), BLOCK):
            b = min(a + BLOCK, len(ids))
            low, high = max(0, a - HALO), min(len(ids), b + HALO)
            here = part[low:high]
            one = np.maximum(stacked(self._inputs(ids[low:high], here)) @ self.w["conv1"] + self.w["bias1"], 0) * (here >= 0)[:, None]
            two = np.maximum(stacked(one) @ self.w["conv2"] + self.w["bias2"], 0)[a - low : b - low]
            real = np.flatnonzero(part[a:b] >= 0)
            if not len(real):
                continue
            seg = place[a:b][real]
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            top[seg[first]] = np.maximum(top[seg[first]], np.maximum.reduceat(two[real], first))
            inside = np.flatnonzero(seg[first] % 3 == 1)
            total[seg[first][inside] // 3] += np.add.reduceat(two[real], first)[inside]
        pooled = np.concatenate([top.reshape(n, -1), total / lengths[:, 1:2]], 1)
        return self._head(pooled)[1]

    def probability(self, items: Sequence[tuple[np.ndarray, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(items) + self.shift, -60, 60)))

    def _gradients(self, ids: np.ndarray, region: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over windows padded to one length."""
        w, n = self.w, len(y)
        there = (region >= 0)[..., None]
        x0 = stacked(self._inputs(ids, region))
        one = np.maximum(x0 @ w["conv1"] + w["bias1"], 0) * there
        x1 = stacked(one)
        two = np.maximum(x1 @ w["conv2"] + w["bias2"], 0) * there
        size = np.maximum((region == 1).sum(1), 1)[:, None].astype(np.float32)
        tops = [two * (region == r)[..., None] for r in range(3)]
        most = [t.argmax(1) for t in tops]
        pooled = np.concatenate([*[np.take_along_axis(t, m[:, None], 1)[:, 0] for t, m in zip(tops, most, strict=True)], tops[1].sum(1) / size], 1)
        hidden, z = self._head(pooled)
        dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n).astype(np.float32)[:, None]
        g = {"out": hidden.T @ dz, "bias4": dz.sum(0)}
        dh = (dz @ w["out"].T) * (hidden > 0)
        g |= {"dense": pooled.T @ dh, "bias3": dh.sum(0)}
        dp = dh @ w["dense"].T
        dtwo = (region == 1)[..., None] * (dp[:, 3 * FILTERS :] / size)[:, None]
        for r, m in enumerate(most):
            spot = np.zeros_like(two)
            np.put_along_axis(spot, m[:, None], dp[:, r * FILTERS : (r + 1) * FILTERS][:, None], 1)
            dtwo = dtwo + spot * (region == r)[..., None]
        dtwo = dtwo * (two > 0)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g |= {"conv2": flat(x1).T @ flat(dtwo), "bias2": flat(dtwo).sum(0)}
        done = unstacked(dtwo @ w["conv2"].T, FILTERS) * (one > 0)
        g |= {"conv1": flat(x0).T @ flat(done), "bias1": flat(done).sum(0)}
        dx = unstacked(done @ w["conv1"].T, EMBED + 3) * there
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], ids.ravel(), flat(dx)[:, :EMBED])
        return g

    def fit(self, items: Sequence[tuple[np.ndarray, int, int]], label: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 1) -> SecretNet:
        """Adam on batches of windows of like length; one row in four is kept for the calibration and the threshold."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(items))
        held, rest = order[: len(items) // 4], order[len(items) // 4 :]
        rest = rest[np.argsort([len(items[i][0]) for i in rest], kind="stable")]
        steps = [rest[i : i + batch] for i in range(0, len(rest), batch)]
        m, v, t = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        for epoch in range(epochs):
            for s in rng.permutation(len(steps)):
                ids, region = padded([items[i] for i in steps[s]])
                t += 1
                slow = rate / (1 + epoch / 3)
                for k, g in self._gradients(ids, region, label[steps[s]]).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= (slow * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        self._calibrate([items[i] for i in held], label[held])
        return self

    def _calibrate(self, items: Sequence[tuple[np.ndarray, int, int]], y: np.ndarray, recall: float = RECALL) -> None:
        """A logistic regression of the labels on the logits, with labels drawn in a little so that it stays finite; then the threshold."""
        if len(set(y.tolist())) < 2:
            return  # nothing to calibrate with: the scores stay, and one half is the threshold
        z = self.logits(items).astype(float)
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            q = np.maximum(p * (1 - p), 1e-9)
            hess = np.array([[(q * z * z).sum() + 1e-6, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
            step = np.linalg.solve(hess, [((p - goal) * z).sum(), (p - goal).sum()])
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        good = np.sort(self.probability([i for i, l in zip(items, y, strict=True) if l > 0]))
        self.threshold = float(good[int(np.floor((1 - recall) * len(good)))])


def padded(items: Sequence[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(chars) for chars, _, _ in items)
    ids, region = np.zeros((len(items), longest), np.int32), np.full((len(items), longest), -1)
    for i, (chars, a, b) in enumerate(items):
        ids[i, : len(chars)] = chars
        region[i, : len(chars)] = np.repeat([0, 1, 2], [a, b - a, len(chars) - b])
    return ids, region


# labelled findings -----------------------------------------------------------

# Ways to write a secret or something that only looks like one, and words around them.
SECRET_CONTEXTS = (
    "Authorization: Bearer {}", "client_secret = '{}'", "aws_secret_access_key={}", "private_key: {}", "credentials {}", "passphrase is {}", "auth={}", "login key {}", "X-Auth: {}", "SECRET_KEY={}", "access_key: \"{}\"", "pwd={}", "signing key {}", "bearer {}",
    "session_key {}", "refresh_token {}", "use the key {} to sign in", "https://user:{}@host", "export KEY='{}'", "\"apikey\": \"{}\"", "token = \"{}\"", "password={}", "{}",
)
OTHER_CONTEXTS = (
    "commit {}", "sha256 {}", "checksum: {}", "md5sum {}", "digest={}", "id: {}", "order {}", "see /files/{}.html", "invoice {}", "request_id={}", "version {}", "ISBN {}", "call {}", "tracking {}", "merge {}", "at {}", "build {}", "page {}", "etag: {}", "class=\"{}\"", "{}",
)
FILLERS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only der die das und ein nicht mit les des une pour dans que los del una por con".split()
ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """The default table of ``(text, start, end, secret)``, made by rule: random keys and things that look like keys, among filler words."""
    rng = random.Random(seed)
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    digits, hexes = "0123456789", "0123456789abcdef"
    secrets = (
        lambda: some(hexes, rng.choice((32, 40, 48, 64))),
        lambda: some(hexes.upper(), rng.choice((32, 40))),
        lambda: some(ALPHANUMERIC + "+/", rng.choice((40, 44, 64))) + rng.choice(("", "=", "==")),
        lambda: some(ALPHANUMERIC + "_-", rng.choice((22, 36, 43))),
        lambda: some(ALPHANUMERIC, rng.randint(20, 48)),
        lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "pk_test_")) + some(ALPHANUMERIC, rng.randint(20, 36)),
        lambda: "AKIA" + some(ALPHANUMERIC[:26] + digits, 16),
        lambda: "eyJ" + some(ALPHANUMERIC + "_-", rng.randint(30, 90)),
    )
    words = lambda k, by: by.join(rng.choice(FILLERS) for _ in range(k))
    others = (
        lambda: some(digits, rng.randint(16, 20)),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}",
        lambda: "-".join(some(digits, k) for k in (4, 4, 4, 4)),
        lambda: f"{words(rng.randint(3, 6), '-')}-{rng.randint(1, 2030)}",
        lambda: f"{words(rng.randint(3, 5), '_')}_{some(digits, rng.randint(1, 4))}",
        lambda: f"{words(rng.randint(3, 6), '/')}/{rng.randint(1, 999)}",
        lambda: words(rng.randint(5, 9), "") + some(digits, rng.randint(1, 4)),
        lambda: words(rng.randint(5, 9), "").upper() + some(digits, rng.randint(1, 4)),
        lambda: f"{rng.choice('-=_/')}" * rng.randint(12, 40) + some(digits, rng.randint(1, 6)),
        lambda: rng.choice(ALPHANUMERIC) * rng.randint(12, 30) + some(digits, 2),
        lambda: "+" + some(digits, 2) + "-" + some(digits, 3) + "-" + some(digits, 9),
    )
    hashes = lambda: some(hexes, rng.choice((32, 40, 64)))
    uuid = lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))
    rows = []
    for i in range(n):
        secret = i % 2
        if secret:
            value, context = rng.choice(secrets)(), rng.choice(SECRET_CONTEXTS)
        elif rng.random() < 0.3:
            value, context = rng.choice((hashes, uuid))(), rng.choice(OTHER_CONTEXTS[:-1])
        else:
            value, context = rng.choice(others)(), rng.choice(OTHER_CONTEXTS)
        before, after = context.split("{}")
        head, tail = words(rng.randint(0, 12), " "), words(rng.randint(0, 12), " ")
        if rng.random() < 0.1:
            head, tail = head.upper(), tail.upper()
        text = head + " " * bool(head) + before
        start = len(text)
        rows.append((text + value + after + rng.choice((" ", ". ", "\n", "| ")) + tail, start, start + len(value), secret))
    return rows


def train(findings: DataFrame, text: str = "text", start: str = "start", end: str = "end", label: str = "secret", rows: int = MAX_TRAINING) -> SecretNet:
    """A network from at most ``rows`` labelled findings, those of least hash; rows with a null or an empty span are left out."""
    cols = [F.col(text).alias("t"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"), F.col(label).cast("double").alias("y")]
    near = F.substr("t", F.greatest(F.col("a") + 1 - CONTEXT, F.lit(1)).cast("int"), (F.col("b") - F.greatest(F.col("a") - CONTEXT, F.lit(0)) + CONTEXT).cast("int"))
    got = findings.select(cols).where("t is not null and a >= 0 and a < b and y is not null and b <= length(t)")
    got = got.select(near.alias("t"), F.least("a", F.lit(CONTEXT)).alias("s"), (F.col("b") - F.col("a")).alias("n"), "y")
    got = got.orderBy(F.xxhash64("t", "s", "n"), "t", "s", "n", "y").limit(rows).collect()
    items = [w for r in got for w in windows(r["t"], [(r["s"], r["s"] + r["n"])])]
    return SecretNet().fit(items, np.array([r["y"] for r in got])) if got else SecretNet()


def scan(docs: DataFrame, model: SecretNet, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n_assign, n_access, n_hex, base_sha256, spans)`` for each row of ``docs``, in one pass without a shuffle.

    ``spans`` lists kind:start:end in code points, the end exclusive, by start, then kind: all that the patterns
    find, and as kind 'model' each candidate that meets none of these and whose probability
    reaches the model's threshold. ``base_sha256`` is the hash of the list without the model's.
    Null texts count as empty and have empty lists; ids may be null or repeated; texts of any
    length are read whole; other columns are not looked at; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 10 000 weights

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            base, added = [], [[] for _ in range(batch.num_rows)]
            rows, spans, items, held = [], [], [], 0

            def judge() -> None:
                for i, (a, b), p in zip(rows, spans, net.probability(items), strict=True):  # noqa: B023
                    if p >= net.threshold:
                        added[i].append((a, 3, b))  # noqa: B023

            for i, value in enumerate(batch.column(1)):
                t = value.as_py()
                found = base_spans(t)
                base.append(found)
                for span in apart(candidates(t), found):
                    w = windows(t, [span])[0]
                    rows.append(i)
                    spans.append(span)
                    items.append(w)
                    held += len(w[0])
                    if held > 16 * BLOCK:
                        judge()
                        rows, spans, items, held = [], [], [], 0
            judge()
            counts = [[sum(k == kind for _, k, _ in s) for s in base] for kind in range(3)]
            digests = [hashlib.sha256(listed(s).encode()).hexdigest() for s in base]
            every = [listed(sorted(s + m)) for s, m in zip(base, added, strict=True)]
            cols = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def apart(spans: Sequence[tuple[int, int]], base: Sequence[Span]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``base``, both in order of start."""
    out, k, reach = [], 0, 0
    for a, b in spans:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out
