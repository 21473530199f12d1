"""Secret scan: three fixed rules, and automata that learn the formats of credentials.

The values that the rules find are labelled credentials. For each rule a prefix tree of a
bounded sample of them is built over classes of characters, and its states are merged
wherever their outgoing frequencies agree within a Hoeffding bound (ALERGIA), which gives a
probabilistic automaton. Every other candidate token is scored under each automaton against
an automaton of ordinary candidates; a token whose log-likelihood ratio, of the whole token,
is high enough is a further span of kind ``grammar``. Spans of the rules always stay.

Candidates that an automaton of credentials accepts (their mean log-likelihood is that of its
own values) are no sample of ordinary ones, however many there are; those among them that the
rest explain better are added to it afterwards.

Automata are fitted on at most SAMPLE distinct values of a kind, of at most LONGEST characters
each; every candidate is scored whole, however long it is.

Positions count code points; a null text counts as empty and has no spans; repeated rows give
a row each; an empty table gives an empty result; other columns are ignored. Texts are
scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import settle, slices

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: A longer least length in the expression is the same as dropping short runs: both take whole runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A text without a match of this holds no span of any kind.
ANY = r"(?i)(password|passwd|secret|token|api_?key)|[A-Za-z0-9+/_=-]{16}"
#: Labelled values per kind, and ordinary candidates, that automata are fitted on at most.
SAMPLE = 1500
#: Longer values teach nothing, but are scored.
LONGEST = 2048
#: Least log-likelihood ratio of a token, for a character of the shortest candidate and its end.
LEAST_RATIO = 1.0
SHORTEST = 16
#: An automaton accepts what has the mean log-likelihood for a character of its values, but for the lowest hundredth, or is lower by so much.
ACCEPT_SLACK = 0.5
#: What an accepted token's ratio is below zero at least if it is an ordinary one.
BACK_RATIO = 0.25


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, index of the kind, end, value) of the matches of the three rules."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens of 16 characters or more that hold a digit and a letter and touch no span in taken."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and not any(m.start() < t[2] and t[0] < m.end() for t in taken):
            out.append((m.start(), m.end(), token))
    return out


def symbols(token: str) -> str:
    """The class of each character: h a-f, a other lower case, H A-F, A other upper case, 9 digit, else itself."""
    return "".join("9" if c.isdigit() else ("h" if c in "abcdef" else "a") if c.islower() else ("H" if c in "ABCDEF" else "A") if c.isupper() else c for c in token)


class Automaton:
    """A deterministic probabilistic automaton by state merging (ALERGIA)."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for s in strings:
            at = 0
            for c in [*s, ""]:
                self.count[at][c] += 1
                if c:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.count.append(Counter())
                    at = self.next[at][c]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.size = len(strings)
        self._merge()

    def _alike(self, a: int, b: int, depth: int = 0) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            m, n = sum(self.count[a].values()), sum(self.count[b].values())
            if not m or not n:
                continue
            slack = self.bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if any(abs(self.count[a][c] / m - self.count[b][c] / n) > slack for c in {*self.count[a], *self.count[b]}):
                return False
            stack += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Merge the tree below b into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.count[a].update(self.count[b])
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda x: -sum(self.count[self.next[x[0]][x[1]]].values()))
            source, c = blue.pop(0)
            node = self.next[source][c]
            into = next((r for r in red if self._alike(r, node)), None)
            if into is None:
                red.append(node)
            else:
                self.next[source][c] = into
                self._fold(into, node)
            kept = set(red)
            blue = [(r, c) for r in red for c in self.next[r] if self.next[r][c] not in kept]
        self.states = red

    def logp(self, s: str, floor: float = 0.002) -> float:
        """Natural logarithm of the probability of s; what was never seen costs `floor` a character."""
        at, total = 0, 0.0
        for c in [*s, ""]:
            if at is None:
                total += math.log(floor)
                continue
            n = sum(self.count[at].values())
            total += math.log(max(floor, self.count[at][c] / n if n else 0))
            at = self.next[at].get(c) if c else at
        return total


class Formats:
    """Automata of credentials, by kind, and one of ordinary tokens."""

    def __init__(self, labelled: dict[int, list[str]], ordinary: list[str]):
        self.known = {k: Automaton([symbols(v) for v in sorted(vs)]) for k, vs in labelled.items() if vs}
        self.floors = {}
        for k, a in self.known.items():
            means = sorted(a.logp(s) / (len(s) + 1) for s in map(symbols, labelled[k]))
            self.floors[k] = means[len(means) // 100] - ACCEPT_SLACK
        self.learn(ordinary)

    def learn(self, ordinary: list[str], accepted: list[str] = ()) -> None:
        """Fit the automaton of ordinary tokens, also on those accepted that an automaton of all candidates explains better than any of credentials does."""
        if accepted:
            self.learn([*ordinary, *accepted])
            ordinary = [*ordinary, *(v for v in accepted if self.ratio(v) < -BACK_RATIO)]
        self.ordinary = Automaton([symbols(v) for v in sorted(ordinary)]) if ordinary else None

    def accepts(self, token: str) -> bool:
        s = symbols(token)
        return any(a.logp(s) / (len(s) + 1) >= self.floors[k] for k, a in self.known.items())

    def ratio(self, token: str) -> float:
        """The best log-likelihood ratio over the kinds, by the length of the shortest candidate; minus infinity if nothing was learnt."""
        if not self.known:
            return -math.inf
        s = symbols(token)
        other = self.ordinary.logp(s) if self.ordinary else (len(s) + 1) * math.log(1 / 40)
        return (max(a.logp(s) for a in self.known.values()) - other) / (SHORTEST + 1)


def _likely(column) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(column, ANY), False)


def fit(docs: DataFrame, most: int = SAMPLE) -> Formats:
    """Learn formats from the values that the rules find in all of docs and from ordinary candidates, `most` distinct ones of each at most."""

    def seen(batches):
        for batch in batches:
            for part in slices(batch, 0):
                found = set()
                for text in part.column(0).filter(_likely(part.column(0))).to_pylist():
                    base = base_spans(text)
                    found.update((k, v) for _, k, _, v in base)
                    found.update((3, v) for _, _, v in candidates(text, base))
                found = sorted(found)
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.string())], ["kind", "value"])

    values = settle(docs.select("text").mapInArrow(seen, "kind int, value string").where(F.length("value") <= LONGEST).distinct())

    def least(values: DataFrame) -> list[str]:
        return [r.value for r in values.orderBy(F.xxhash64("value"), "value").limit(most).select("value").collect()]

    formats = Formats({k: least(values.where(F.col("kind") == k)) for k in range(3)}, [])
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # a few thousand states

    def judged(batches):
        own = shared.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.accepts(v) for v in batch.column(0).to_pylist()], pa.bool_())], ["value", "accepted"])

    judgement = settle(values.where("kind = 3").select("value").mapInArrow(judged, "value string, accepted boolean"))
    formats.learn(least(judgement.where("not accepted")), least(judgement.where("accepted")))
    return formats


def spans(text: str, formats: Formats, least: float = LEAST_RATIO) -> tuple[list, list]:
    """(spans of the rules, all spans) as (start, index of the kind, end)."""
    base = base_spans(text)
    more = []
    for start, end, token in candidates(text, base):
        if formats.ratio(token) >= least:
            more.append((start, 3, end))
    plain = [x[:3] for x in base]
    return plain, sorted(plain + more)


def told(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


NOTHING = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, formats: Formats, least: float = LEAST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_grammar, base_sha256, spans for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # a few thousand states

    def scanned(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                counts, digests, all_spans = [], [], []
                for text in pc.if_else(_likely(part.column(1)), part.column(1), pa.scalar("", pa.string())).to_pylist():
                    base, every = spans(text, own, least) if text else ([], [])
                    n = Counter(k for _, k, _ in every)
                    counts.append((n[0], n[1], n[2], n[3]))
                    digests.append(hashlib.sha256(told(base).encode()).hexdigest() if base else NOTHING)
                    all_spans.append(told(every))
                columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
                yield pa.record_batch([part.column(0), *columns, pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, n_grammar long, base_sha256 string, spans string")


def redact(docs: DataFrame, formats: Formats, least: float = LEAST_RATIO, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by `mark`; n_chars, if there, counts the new text. All other columns stay."""
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def cleaned(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                for i, flag in enumerate(_likely(part.column(at)).to_pylist()):
                    if flag:
                        out, done = [], 0
                        for a, _, b in spans(texts[i], own, least)[1]:
                            if a >= done:
                                out += [texts[i][done:a], mark]
                            done = max(done, b)
                        texts[i] = "".join([*out, texts[i][done:]])
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pc.cast(pc.utf8_length(columns[at]), columns[k].type)
                yield pa.record_batch(columns, names)

    return docs.mapInArrow(cleaned, docs.schema)
