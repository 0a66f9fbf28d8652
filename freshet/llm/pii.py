"""Personal data: exact patterns, and spans that a linear-chain conditional random field adds."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenization import in_parts

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *KINDS)
#: Rows of a labelled table that training accepts; it is fitted on the driver and sent to the executors.
MOST_SENTENCES = 20_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_OPENING, _CLOSING = "\"'<[{", ".,;:!?\"'>]}"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check sum of payment card numbers."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """A run of local characters before each @, as far left as the match before allows, and a dotted domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield "email", begin, domain.end()
            done = domain.end()
        # an @ never lies inside a domain, and a failed one begins no other match
        at, done = text.find("@", max(at + 1, done)), max(done, at + 1 if not domain else done)


def addresses(text: str) -> Iterator[Span]:
    """Four dotted numbers up to 255; a longer chain is divided from its left."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", found.start(), found.end()


def phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in found.group()) <= 15:
            yield "phone", found.start(), found.end()


def base_spans(text: str) -> list[Span]:
    """The exact patterns' matches, by kind and start; code points, end exclusive. The work is linear in the text."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    if _DIGIT.search(text):
        found += addresses(text)
        found += cards(text)
        if "+" in text:
            found += phones(text)
    return found


# --- conditional random field -------------------------------------------------------------------------------------


def core(token: str) -> tuple[int, int]:
    """Where a token's body lies without quotes, brackets and end marks around it."""
    begin = len(token) - len(token.lstrip(_OPENING))
    end = begin + len(token[begin:].rstrip(_CLOSING))
    return (begin, end) if end > begin else (0, len(token))


def plain(token: str) -> bool:
    """Without a digit or @. The model gives such a token no tag but O, so they divide a text into short chains."""
    return "@" not in token and not _DIGIT.search(token)


def marks_only(token: str) -> bool:
    """One or two marks, as between the groups of a number; they belong to the chain of the tokens around them."""
    return len(token) <= 2 and not any(c.isalnum() for c in token)


def shape(body: str) -> str:
    """X, x and 9 for capitals, other letters and digits; runs of letters count once, of digits up to five."""
    marks = "".join("9" if c in "0123456789" else ("X" if c.isupper() else "x") if c.isalpha() else c for c in body)
    return re.sub(r"9{5,}", "99999", re.sub(r"[Xx]+", "x", marks))


def coarse(token: str | None) -> str:
    if token is None:
        return "edge"
    if plain(token):
        return "mark" if marks_only(token) else "word"
    if "@" in token:
        return "at"
    return "number" if not any(c.isalpha() for c in token) else "mixed"


def features(tokens: Sequence[str], k: int, before: str | None, after: str | None) -> list[str]:
    """Shape features of one token and its neighbours; ``before`` and ``after`` are the plain words around the chain."""
    a, b = core(tokens[k])
    body = tokens[k][a:b]
    digits = re.sub(r"[^0-9]", "", body)
    last = tokens[k - 1] if k else before
    following = tokens[k + 1] if k + 1 < len(tokens) else after
    found = [f"shape={shape(body)}", f"kind={coarse(tokens[k])}", f"digits={min(len(digits), 20)}", f"last={coarse(last)}", f"next={coarse(following)}"]
    found.append(f"lead={'none' if not digits else '01' if digits[0] in '01' else '29'}")
    found.append(f"last shape={shape(last[slice(*core(last))])}" if k else "last shape=none")
    found.append(f"next shape={shape(following[slice(*core(following))])}" if k + 1 < len(tokens) else "next shape=none")
    if 13 <= len(digits) <= 19 and len(digits) == len(body.replace("-", "")):
        found.append("luhn" if luhn(digits) else "no luhn")
    if next(iter(addresses(body)), None) == ("ip", 0, len(body)):
        found.append("address")
    if next(iter(emails(body)), None) == ("email", 0, len(body)):
        found.append("mail")
    return found


@dataclass(frozen=True)
class Model:
    """Weights of each feature by tag, and of each tag after another."""

    rows: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, found: Sequence[str]) -> np.ndarray:
        known = [self.rows[f] for f in found if f in self.rows]
        return self.weights[known].sum(axis=0) if known else np.zeros(len(TAGS))


Sentence = tuple[list[str], list[str]]


def labelled_table(seed: int = 7, each: int = 40) -> list[Sentence]:
    """The default labelled table: tokens and tags of short sentences with varied personal data and look-alikes."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def card(n: int, valid: bool) -> str:
        body = str(rng.randint(3, 6)) + digits(n - 2)
        return next(body + d for d in "0123456789" if luhn(body + d) == valid)

    def byte() -> str:
        return str(rng.randint(0, 255))

    makers: list[tuple[str, Callable[[], str]]] = [
        ("email", lambda: f"{word()}{digits(2)}@{word()}.{rng.choice(('com', 'org', 'net', 'es'))}"),
        ("email", lambda: f"{word()}.{word()}@{word()}.example.com"),
        ("ip", lambda: ".".join(byte() for _ in range(4))),
        ("ip", lambda: ".".join(byte() for _ in range(4)) + ":" + str(rng.randint(80, 9000))),
        ("card", lambda: card(16, True)),
        ("card", lambda: card(15, True)),
        ("card", lambda: "-".join(re.findall("....", card(16, True)))),
        ("phone", lambda: f"+{rng.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"+{rng.randint(10, 99)} {digits(3)} {digits(3)} {digits(3)}"),
        ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("phone", lambda: f"+{digits(11)}"),
        ("phone", lambda: f"{digits(3)} - {digits(3)} - {digits(4)}"),
        ("phone", lambda: f"({digits(3)}) / {digits(3)} {digits(4)}"),
        ("O", lambda: card(16, False)),
        ("O", lambda: "1" + digits(12)),
        ("O", lambda: "20" + digits(12)),
        ("O", lambda: digits(rng.randint(17, 24))),
        ("O", lambda: f"{rng.randint(1, 99)} - {rng.randint(1, 2030)}"),
        ("O", lambda: f"{rng.randint(1, 9)} / {rng.randint(1, 99)}"),
        ("O", lambda: f"| {rng.randint(1, 999)} | {rng.randint(1, 99999)} |"),
        ("O", lambda: str(rng.randint(1, 2100))),
        ("O", lambda: f"{rng.randint(1, 12)}.{rng.randint(0, 9)}"),
        ("O", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}"),
        ("O", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        ("O", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}"),
        ("O", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))),
        ("O", lambda: digits(rng.choice((5, 6, 7, 8, 9, 10, 11, 12)))),
        ("O", lambda: f"{rng.randint(1, 999)},{digits(3)}"),
        ("O", lambda: f"({rng.randint(1, 2100)})"),
        ("O", lambda: f"{word()}{rng.randint(1, 99)}"),
        ("O", lambda: f"{rng.randint(300, 999)}.{byte()}.{byte()}.{byte()}"),
        ("O", lambda: f"{rng.randint(1, 99)}%"),
        ("O", lambda: f"${rng.randint(1, 99)}.{digits(2)}"),
        ("O", lambda: f"@{word()}{rng.randint(1, 9)}"),
        ("O", lambda: f"{rng.randint(1, 9)} {rng.randint(10, 99)} {rng.randint(100, 999)}"),
        ("O", lambda: f"{digits(3)}-{digits(2)}"),
        ("O", lambda: f"{rng.randint(1, 30)}-{rng.randint(31, 99)}"),
    ]
    table = []
    for _ in range(each):
        for tag, make in makers:
            made = make().split()
            left, right = [word() for _ in range(rng.randint(0, 3))], [word() for _ in range(rng.randint(0, 3))]
            end = rng.choice(("", "", "", ".", ","))
            table.append(([*left, *made[:-1], made[-1] + end, *right], ["O"] * len(left) + [tag] * len(made) + ["O"] * len(right)))
    return table


def chains(tokens: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Runs [begin, end) of tokens that aren't plain, with single marks between two such tokens."""
    begin = None
    for k, token in enumerate([*tokens, "x"]):
        if not plain(token):
            begin = k if begin is None else begin
        elif begin is not None and not (marks_only(token) and tokens[k - 1 : k] and not plain(tokens[k - 1]) and k + 1 < len(tokens) and not plain(tokens[k + 1])):
            yield begin, k
            begin = None


def chain_features(tokens: Sequence[str], begin: int, end: int) -> list[list[str]]:
    run = tokens[begin:end]
    return [features(run, k, tokens[begin - 1] if begin else None, tokens[end] if end < len(tokens) else None) for k in range(len(run))]


def train(table: Sequence[Sentence], rounds: int = 200, rate: float = 0.1, decay: float = 0.002) -> Model:
    """Weights that make the table's tags most likely, by gradient ascent on all chains at once (forward-backward)."""
    if len(table) > MOST_SENTENCES:
        raise ValueError(f"a labelled table has at most {MOST_SENTENCES} sentences")
    found, tags = [], []
    for tokens, own in table:
        for a, b in chains(tokens):
            found.append(chain_features(tokens, a, b))
            tags.append([TAGS.index(t) for t in own[a:b]])
    rows = {f: i for i, f in enumerate(sorted({f for chain in found for token in chain for f in token}))}
    n, length, size = len(found), max(map(len, found)), len(TAGS)
    ids = np.zeros((n, length, len(rows)), np.float32)
    gold, live = np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, chain in enumerate(found):
        live[i, : len(chain)] = True
        gold[i, : len(chain)] = tags[i]
        for k, token in enumerate(chain):
            ids[i, k, [rows[f] for f in token]] = 1
    truth = np.eye(size)[gold] * live[..., None]
    both = live[:, 1:] & live[:, :-1]
    moved = np.einsum("nka,nkb->ab", truth[:, :-1] * both[..., None], truth[:, 1:])
    params = [np.zeros((len(rows), size)), np.zeros((size, size))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, rounds + 1):
        weights, moves = params
        score = ids @ weights
        forward, backward = np.zeros((n, length, size)), np.zeros((n, length, size))
        forward[:, 0] = score[:, 0]
        for k in range(1, length):
            nxt = logsum(forward[:, k - 1, :, None] + moves, 1) + score[:, k]
            forward[:, k] = np.where(live[:, k, None], nxt, forward[:, k - 1])
        for k in range(length - 2, -1, -1):
            nxt = logsum(moves + (score[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(live[:, k + 1, None], nxt, 0)
        whole = logsum(forward[:, -1], 1)
        unary = np.exp(forward + backward - whole[:, None, None]) * live[..., None]
        pair = np.exp(forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * both[..., None, None]
        slopes = [np.einsum("nkf,nkt->ft", ids, truth - unary) / n - decay * weights, (moved - pair.sum(axis=(0, 1))) / n - decay * moves]
        for p, g, m, v in zip(params, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(rows, params[0], params[1])


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each chain; ``scores`` is chains x tokens x tags, padded."""
    n, length, size = scores.shape
    best, back = scores[:, 0].copy(), np.zeros((n, length, size), int)
    for k in range(1, length):
        reach = best[:, :, None] + moves
        back[:, k] = reach.argmax(axis=1)
        nxt = reach.max(axis=1) + scores[:, k]
        best = np.where((k < lengths)[:, None], nxt, best)
    tags = np.zeros((n, length), int)
    tags[np.arange(n), lengths - 1] = best.argmax(axis=1)
    for k in range(length - 1, 0, -1):
        own = k < lengths
        tags[own, k - 1] = back[own, k, tags[own, k]]
    return tags


def begins_anew(token: str) -> bool:
    """Whether a token after one of the same tag is a datum of its own: a whole card, address or mail, or a plus sign."""
    a, b = core(token)
    body = token[a:b]
    digits = re.sub(r"[^0-9]", "", body)
    return body[:1] == "+" or "@" in body or len(digits) >= 13 or next(iter(addresses(body)), None) == ("ip", 0, len(body))


def tagged_spans(texts: Sequence[str], model: Model, width: int = 64) -> list[list[Span]]:
    """The spans that the model finds in each text: maximal runs of one tag, each whole datum by itself, without marks around it.

    Chains are decoded together, shorter ones first, so that padding costs at most as much as the chains.
    """
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list[tuple[int, str]], np.ndarray]] = []
    for i, text in enumerate(texts):
        if "@" not in text and not _DIGIT.search(text):
            continue
        tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
        words = [t for _, t in tokens]
        for a, b in chains(words):
            held.append((i, tokens[a:b], np.array([model.scores(f) for f in chain_features(words, a, b)])))
    held.sort(key=lambda h: len(h[1]))
    begin = 0
    while begin < len(held):
        longest = len(held[min(begin + 4095, len(held) - 1)][1])
        end = min(len(held), begin + max(1, 4096 * width // max(width, longest)))
        part = held[begin:end]
        lengths = np.array([len(t) for _, t, _ in part])
        scores = np.zeros((len(part), int(lengths.max()), len(TAGS)))
        for k, (_, _, s) in enumerate(part):
            scores[k, : len(s)] = s
        for (i, tokens, _), tags in zip(part, viterbi(scores, lengths, model.moves), strict=True):
            k = 0
            while k < len(tokens):
                stop = k + 1
                while stop < len(tokens) and tags[stop] == tags[k] and not begins_anew(tokens[stop][1]):
                    stop += 1
                if tags[k]:
                    first, last = tokens[k], tokens[stop - 1]
                    out[i].append((TAGS[tags[k]], first[0] + core(first[1])[0], last[0] + core(last[1])[1]))
                k = stop
        begin = end
    return out


def all_spans(base: Sequence[Span], added: Sequence[Span]) -> list[Span]:
    """Base spans and the added ones that touch none of them, by kind and start."""
    kept, taken = [], sorted((b[1], b[2]) for b in base)
    reach = list(itertools.accumulate((end for _, end in taken), max))
    for s in added:
        # of the base spans that begin before this one ends, the farthest end decides
        k = bisect_left(taken, (s[2],))
        if not k or reach[k - 1] <= s[1]:
            kept.append(s)
    return sorted({*base, *kept}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def personal_data(docs: DataFrame, table: Sequence[Sentence] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, begin, end) in code points of each row's whole text.

    ``base`` has the exact patterns' matches; ``spans`` has these and what the model adds beside them. A null or empty text
    has none; equal rows have equal spans, an empty table gives no rows, and other columns play no part. The work is
    linear in a text, and very long ones are taken a few at a time. The model is trained here, from the labelled table, and
    has bounded size. It tags tokens with a digit or @ and single marks between such tokens, so that data written in
    words alone are not found.
    """
    model = train(labelled_table() if table is None else table)
    span = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in in_parts(texts):
                part = texts[begin:end]
                base = [base_spans(t) for t in part]
                spans = [all_spans(b, a) for b, a in zip(base, tagged_spans(part, model), strict=True)]
                pack = lambda rows: pa.array([[dict(zip(("kind", "begin", "end"), s, strict=True)) for s in row] for row in rows], pa.list_(span))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pack(base), pack(spans)], ["doc_id", "base", "spans"])

    kind, shape_ = docs.schema[id_column].dataType.simpleString(), "array<struct<kind:string,begin:bigint,end:bigint>>"
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, base {shape_}, spans {shape_}")


def redact(text: str, spans: Sequence[Span]) -> str:
    """The text with ``[kind]`` in place of each span."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: s[1:]):
        if begin >= at:
            out += [text[at:begin], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def digest(spans: Sequence[Span]) -> str:
    """SHA-256 of ``kind:begin:end``, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
