"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags the tokens of every text as begin, inside or outside of a secret, from their shape, the words
around them and features of the file, and is decoded by Viterbi. Every token can begin a secret or be inside or
outside of one. White space is outside, so a chain falls into parts between white space, and decoding all parts is
decoding the whole text. Equal parts after equal words are decoded once. Parts of plain words are passed over where
the weights leave them no other best tags than outside: a bound over all features that they can have shows it.

The weights are learnt from rows that the patterns label: LABELLED documents with a match and as many without,
those with the least hashes of their ids, with all their chains; equal chains count as often as they occur. Each
chain with a secret is also learnt with its neighbours hidden. In learning only, chains longer than LEARNT tokens
are cut, never inside a secret.
Without a labelled secret nothing is learnt and the patterns stand alone.

Null or empty text has no spans. Rows with equal ids or texts each get their own. An empty table gives an empty
result. Columns that the operator adds replace those of the same name.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "crf")
_LETTERS = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rf"""({'|'.join(map(_LETTERS, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # runs are maximal, so those of 32 or more are the long ones of all runs

#: Labelled documents of either kind that the weights are learnt from.
LABELLED = 1500
#: Steps in learning, and tokens after which a chain is cut there.
STEPS = 150
LEARNT = 64
#: Decoded parts that a worker remembers, of at most so many characters, and characters before a part that features see.
KNOWN = 30_000
SHORT = 64
SEEN = 40
#: Text bytes that a worker makes into one batch: not a whole batch of Spark's at a time, which may hold 10,000 long texts.
MADE_BYTES = 2 << 20

GAP = re.compile(r"(\s+)")
PART = re.compile(r"\S+")
SPACED = re.compile(r"\s*(\S+)\s*")
WORD = re.compile(r"\w")
TOKEN = re.compile(r"[\w+/-]+|[^\w\s]")
BEFORE = re.compile(r"([\w+/-]+)(\W*)\Z")
KEY_WORDS = "pass pwd secret token key auth cred bearer private access sig".split()
KEYS = re.compile("|".join(KEY_WORDS), re.I)
#: Letters of plain words, and signs that may stand with them. None of them counts for the tokens around.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = ".,;!?*$%&|"
LONGEST = 40
LENGTHS = (8, 12, 16, 18, 20, 24, 32, 40, 41, 64)
FEATURES = 10 + 12 + 5 + 9 + 4 + 4
OUT, BEGIN, IN = range(3)
ONE = [(True, True, False)]

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def matches(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, own) for s, k, e, own in sorted(out)]


def file_features(text: str) -> list[int]:
    """Features of the whole document, as numbers of columns."""
    n = max(1, len(text))
    signs = sum(map(text.count, "={};"))
    return [0 if 200 * signs > n else 1, 2 if n < 2000 else 3]


@lru_cache(KNOWN)
def word_features(word: str) -> tuple[int, ...]:
    """Columns of a token by itself."""
    n = len(word)
    out = [sum(n >= x for x in LENGTHS) - 1] if n >= LENGTHS[0] else [40 + (n >= 4)]
    plain = word.isascii()
    if plain and word.isalpha():
        digits = turns = 0
        lower, upper = word.upper() != word, word.lower() != word
    else:
        digits, lower, upper = sum(c.isdigit() for c in word), any(c.islower() for c in word), any(c.isupper() for c in word)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:], strict=False))
    spread = math.log2(n) - sum(k * math.log2(k) for k in map(word.count, set(word)) if k > 1) / n + 1e-9
    hexes = not word.strip("0123456789abcdef")
    if digits == n:
        out.append(10)
    if hexes and lower and digits < n:
        out.append(11)
    if upper and not lower and digits < n:
        out.append(12)
    if upper and lower:
        out.append(13)
    if lower and not upper and not hexes:
        out.append(14)
    if not plain:
        out.append(15)
    out += [c for c, x in ((16, "+" in word or "/" in word), (17, "-" in word), (18, "_" in word), (19, turns >= 4), (20, turns <= 1), (21, n == 1)) if x]
    return (*out, 43 if digits else 42, 22 + min(4, max(0, int(2 * spread) - 4)))


def token_features(tokens: list[tuple[str, int]], i: int, before: str, text: str, end: int) -> list[int]:
    """Columns of one token. before: up to SEEN characters before the part."""
    out = list(word_features(tokens[i][0]))
    left, right = tokens[i - 1][0] if i else "", tokens[i + 1][0] if i + 1 < len(tokens) else text[end : end + 1].strip()
    lead = text[tokens[0][1] : tokens[i][1]] if i and tokens[i][1] - tokens[0][1] < SEEN else text[tokens[i][1] - SEEN : tokens[i][1]] if i else ""
    lead = before + lead if len(lead) < SEEN else lead
    m = BEFORE.search(lead)
    near = (
        left in ("=", ":") or bool(m and m[2] and m[2].strip(" \"'") in ("=", ":")), bool(m and m[2] and KEYS.search(m[1])), left in ("'", '"'), right in ("'", '"'),
        right == "@" or left == "@", right == ".", left == ".", left in ("(", "+", "#"), not left and not right,
    )
    return out + [27 + k for k, x in enumerate(near) if x]


def chain(text: str, start: int, end: int, own: list[int]) -> tuple[list, list, list]:
    """Of the part from start to end: tokens with their places, columns, tags that each can have."""
    tokens = [(t.group(), t.start()) for t in TOKEN.finditer(text, start, end)]
    before = text[max(0, start - SEEN) : start]
    columns = [token_features(tokens, i, before, text, end) + own for i in range(len(tokens))]
    return tokens, columns, [(True, True, i > 0) for i in range(len(tokens))]


def key_places(text: str) -> list[int]:
    """Where KEYS match, at least the first place in each part, in order."""
    low = text.lower()
    if len(low) != len(text) or "\u017f" in low:  # letters whose lower case is longer, or that KEYS takes for an s
        return [m.start() for m in KEYS.finditer(text)]
    out = []
    for word in KEY_WORDS:
        at = low.find(word)
        while at >= 0:
            out.append(at)
            at = low.find(word, at + len(word))
    return sorted(out)


def context(before: str) -> tuple[bool, str | None]:
    """All that features see of what stands before a part: whether its last word names a secret, and what follows that."""
    m = BEFORE.search(before)
    return bool(m and KEYS.search(m[1])), m and m[2]


def parts(text: str, tails: dict):
    """(start, part, context) of every part of text. tails: what is known of words."""
    at, bits, seen = 0, GAP.split(text), context("")
    for i in range(0, len(bits), 2):
        part = bits[i]
        if part:
            yield at, part, seen
        if i + 1 < len(bits):
            gap = bits[i + 1]
            at += len(part) + len(gap)
            if part not in tails:
                if len(tails) >= KNOWN:
                    tails.clear()
                if len(part) <= SHORT:
                    tails[part] = context(part) if WORD.search(part) else None
            tail = tails.get(part)
            if tail and len(part) + len(gap) <= SEEN:
                seen = tail[0], tail[1] + gap
            else:
                seen = context(text[max(0, at - SEEN) : at])


def chains(text: str, known: dict | None = None, tails: dict | None = None):
    """For every part of text: (tokens with their places, columns, tags that each can have). known, tails: of earlier texts."""
    own, known = [36 + k for k in file_features(text)], {} if known is None else known
    for at, part, seen in parts(text, {} if tails is None else tails):
        if part.isalpha():  # one token, near which is nothing but the context
            named = seen[1] or ""
            near = [27] * (named.strip(" \"'") in ("=", ":")) + [28] * bool(named and seen[0])
            yield [(part, at)], [[*word_features(part), *near, 35, *own]], ONE
            continue
        key = (part, seen, *own)
        if key not in known:
            if len(known) >= KNOWN:
                known.clear()
            tokens, columns, allowed = chain(text, at, at + len(part), own)
            known[key] = [(t, x - at) for t, x in tokens], columns, allowed
        tokens, columns, allowed = known[key]
        yield [(t, at + x) for t, x in tokens], columns, allowed


class Field:
    """weights: FEATURES x tags; steps: tag x tag; the first tag of a chain follows outside."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps.copy()
        self.known, self.older, self.tails, self.decoded = {}, {}, {}, {}
        self.steps[OUT, IN] = -1e6
        self.longest = self._longest()
        run = rf"[{LETTERS}]{{1,{self.longest}}}+(?![{LETTERS}])|[{re.escape(SIGNS)}]"
        #: All plain parts from here on, with the white space after them.
        self.plain = re.compile(rf"(?:(?:{run})++(?!\S)\s*+)*+") if self.longest else None

    def _outside(self, columns: list[int], some: list[list[int]], any_: list[int]) -> bool:
        """Whether a token is outside in all best tags: it has columns, one of each list of some, and any of any_.

        What a tag may gain over outside is at most its own score, the best step to it and the best step back.
        """
        own = 0.0
        back = max(0.0, *(self.steps[[BEGIN, IN], OUT] - self.steps[OUT, OUT]))
        best = -np.inf
        for tag in (BEGIN, IN):
            more = self.weights[:, tag] - self.weights[:, OUT]
            own = more[columns].sum() + sum(max(more[c] if c is not None else 0.0 for c in x) for x in some) + np.maximum(more[any_], 0).sum()
            best = max(best, own + self.steps[:, tag].max() - self.steps[OUT, OUT] + back)
        return bool(best < -1e-6)

    def _longest(self) -> int:
        """Words of letters of at most this length, and SIGNS, are outside of a secret unless something near tells; 0: none."""
        rest = [[36, 37], [38, 39]]
        near = [27 + 5, 27 + 6, 27 + 8]  # of what stands near, only a dot or nothing
        if not self._outside([40, 20, 21, 42, 22], rest, near):
            return 0
        for n in range(1, LONGEST + 1):
            length = sum(n >= x for x in LENGTHS) - 1 if n >= LENGTHS[0] else 40 + (n >= 4)
            shapes = [[11, 12, 13, 14, None], [15, None], [22, 23, 24, 25, 26]]
            if not self._outside([length, 20, 42, *[21] * (n == 1)], [*shapes, *rest], near):
                return n - 1
        return LONGEST

    def scores(self, columns: list[list[int]], allowed: list[tuple]) -> np.ndarray:
        out = np.zeros((len(columns), 3))
        for i, c in enumerate(columns):
            if c:
                out[i] = self.weights[c].sum(axis=0)
            out[i, ~np.array(allowed[i])] = -1e6
        return out

    def decode(self, columns: list[list[int]], allowed: list[tuple]) -> list[int]:
        """The best tags of a chain, by Viterbi."""
        scores = self.scores(columns, allowed)
        best, back = self.steps[OUT] + scores[0], []
        for s in scores[1:]:
            every = best[:, None] + self.steps
            back.append(every.argmax(axis=0))
            best = every.max(axis=0) + s
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def part(self, text: str, start: int, end: int, own: list[int]) -> list[tuple[int, int]]:
        """Spans of one part, from its start."""
        out, at = [], None
        tokens, columns, allowed = chain(text, start, end, own)
        key = tuple(map(tuple, columns[: SHORT + 1]))
        tags = self.decoded.get(key) if len(columns) <= SHORT else None
        if tags is None:
            tags = self.decode(columns, allowed)
            if len(columns) <= SHORT and len(self.decoded) < KNOWN:
                self.decoded[key] = tags
        for (word, place), tag in zip([*tokens, ("", end)], [*tags, OUT], strict=True):
            if tag != IN and at is not None:
                out.append(tuple(at))
                at = None
            if tag == BEGIN:
                at = [place - start, place - start + len(word)]
            elif tag == IN:
                at[1] = place - start + len(word)
        return out

    def _parts(self, text: str):
        """(start, part, context) of the parts that can hold a secret: those that are not plain, and what follows them up to a word."""
        keys, end = [], 0  # starts of parts with a word that names a secret
        for found in key_places(text):
            if found >= end:
                at = found
                while at > end and not text[at - 1].isspace():
                    at -= 1
                keys.append(at)
                end = PART.match(text, found).end()
        keys.append(len(text))
        at = k = 0
        while True:
            while keys[k] < at:
                k += 1
            at = self.plain.match(text, at, keys[k]).end()
            told = False
            while True:
                m = SPACED.match(text, at)
                if not m:
                    return
                at = m.end()
                yield m.start(1), m[1], context(text[max(0, m.start(1) - SEEN) : m.start(1)])
                if told and WORD.search(m[1]):
                    break
                told = True

    def spans(self, text: str) -> list[tuple[int, int]]:
        out, (signs, size) = [], file_features(text)
        own = [36 + signs, 36 + size]
        for at, part, seen in self._parts(text) if self.plain else parts(text, self.tails):
            key = (part, seen, signs, size)
            hit = self.known.get(key)
            if hit is None:
                hit = self.older.get(key)
                if hit is None:
                    hit = self.part(text, at, at + len(part), own)
                if len(part) <= SHORT:
                    if len(self.known) >= KNOWN:
                        self.known, self.older = {}, self.known
                    self.known[key] = hit
            if hit:
                out += [(at + s, at + e) for s, e in hit]
        return out


def labelled(text: str, known: dict | None = None, tails: dict | None = None) -> list[tuple[list, list, list]]:
    """(columns, allowed, tags) of the chains of a text, tagged by the patterns; those with a secret also without their neighbours."""
    found, out, lo = sorted((own, end) for _, _, end, own in matches(text)), [], 0
    for tokens, columns, allowed in chains(text, known, tails):
        while lo < len(found) and found[lo][1] <= tokens[0][1]:
            lo += 1
        if len(tokens) <= LEARNT and (lo == len(found) or found[lo][0] > tokens[-1][1]):
            out.append((columns, allowed, [OUT] * len(tokens)))
            continue
        tags, open_ = [], None
        for word, start in tokens:
            hit = None
            for x in found[lo:] if lo < len(found) and found[lo][0] <= start else ():
                if x[0] > start:
                    break
                if start + len(word) <= x[1]:
                    hit = x
                    break
            tags.append(OUT if hit is None else IN if hit == open_ else BEGIN)
            open_ = hit
        at = 0
        while at < len(tags):
            end = min(at + LEARNT, len(tags))
            while end < len(tags) and tags[end - 1] != OUT:
                end += 1
            out.append((columns[at:end], [(True, True, i > 0) for i in range(end - at)], tags[at:end]))
            if any(tags[at:end]):
                out.append(([[c for c in x if not 27 <= c < 36] for x in columns[at:end]], out[-1][1], tags[at:end]))
            at = end
    return out


def fitted(examples: list[tuple[list, list, list]], steps: int = STEPS, counts: list[int] | None = None) -> Field | None:
    """Weights of the greatest regularised likelihood, by gradient ascent with forward-backward over all chains at once.

    counts: how often each example occurs. Chains of like length are padded together.
    """
    if not any(any(t) for _, _, t in examples):
        return None
    like: dict[int, list] = {}
    for (columns, _, tags), k in zip(examples, counts or [1] * len(examples), strict=True):
        like.setdefault((len(tags) - 1).bit_length(), []).append((columns, tags, k))
    w, t = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    gold_w, gold_steps, weight, groups = np.zeros_like(w), np.zeros_like(t), 0, []
    for held in like.values():
        n, length = len(held), max(len(tags) for _, tags, _ in held)
        x = np.zeros((n, length, FEATURES), np.float32)
        gold, live = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
        for i, (columns, tags, _) in enumerate(held):
            live[i, : len(tags)], gold[i, : len(tags)] = True, tags
            for j, c in enumerate(columns):
                x[i, j, c] = 1
        many = np.array([k for _, _, k in held], float)
        ban = np.zeros((n, length, 3))
        ban[~live] = [0, -1e6, -1e6]
        before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
        np.add.at(gold_steps, (before[live], gold[live]), np.broadcast_to(many[:, None], live.shape)[live])
        flat = x.reshape(-1, FEATURES)
        mass = live * many[:, None]
        gold_w += flat.T @ (np.eye(3)[gold] * mass[..., None]).reshape(-1, 3).astype(np.float32)
        weight += many.sum()
        groups.append((n, length, flat, ban, mass))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    total = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for step in range(1, steps + 1):
        tt = t.copy()
        tt[OUT, IN] = -1e6
        want_w, pairs = np.zeros_like(w), np.zeros((3, 3))
        for n, length, flat, ban, mass in groups:
            s = (flat @ w.astype(np.float32)).reshape(n, length, 3) + ban
            alpha = [tt[OUT] + s[:, 0]]
            for j in range(1, length):
                alpha.append(total(alpha[-1][:, :, None] + tt, 1) + s[:, j])
            z = total(alpha[-1], 1)[:, None]
            beta, marginal = np.zeros((n, 3)), np.zeros((n, length, 3))
            for j in range(length - 1, -1, -1):
                marginal[:, j] = np.exp(alpha[j] + beta - z)
                if j:
                    both = np.exp(alpha[j - 1][:, :, None] + tt + (s[:, j] + beta)[:, None] - z[:, :, None])
                    pairs += (both * mass[:, j, None, None]).sum(axis=0)
                    beta = total(tt + (s[:, j] + beta)[:, None], 2)
            marginal *= mass[..., None]
            pairs[OUT] += marginal[:, 0].sum(axis=0)
            want_w += flat.T @ marginal.reshape(-1, 3).astype(np.float32)
        grads = [(gold_w - want_w) / weight - 1e-4 * w, (gold_steps - pairs) / weight - 1e-4 * t]
        for k, (p, g) in enumerate(zip((w, t), grads, strict=True)):  # Adam
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            p += 0.2 * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(w, t)


#: A first sieve for rows that the patterns may label.
SIEVE = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = LABELLED) -> Field | None:
    """The field for a corpus, from at most 2 x most documents of it."""
    ids = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text).rlike(SIEVE), F.lit(False)).alias("hit")).select("doc", "hit", F.xxhash64(F.col("doc").cast("string")).alias("h"))
    chosen = ids.filter("hit").orderBy("h", "doc").limit(most).unionByName(ids.filter("not hit").orderBy("h", "doc").limit(most)).select("doc").collect()
    chosen = sorted({r["doc"] for r in chosen if r["doc"] is not None})
    if not chosen:
        return None
    rows = docs.filter(F.col(id_col).isin(chosen)).select(F.col(id_col).cast("string").alias("doc"), F.col(text).alias("text"))

    def make(batches):
        known, tails = {}, {}
        for batch in batches:
            seen = Counter((tuple(map(tuple, x[0])), tuple(x[2])) for piece in pieces(batch, 1) for value in piece.column(1).to_pylist() for x in labelled(value or "", known, tails))
            yield pa.record_batch([pa.array(list(map(json.dumps, seen)), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chain", "n"])

    found = sorted((r["chain"], r["n"]) for r in rows.mapInArrow(make, "chain string, n long").groupBy("chain").agg(F.sum("n").alias("n")).collect())
    examples = [(columns, [], tags) for columns, tags in (json.loads(c) for c, _ in found)]
    return fitted(examples, counts=[n for _, n in found])


def found(text: str, field: Field | None) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) of patterns and field, by start, then kind as listed."""
    base = matches(text)
    if field is None:
        return base
    out, ends = list(base), sorted((s, e) for s, _, e, _ in base)
    for start, end in field.spans(text):
        if not any(s < end and start < e for s, e in ends):
            out.append((start, "crf", end, start))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def pieces(batch: pa.RecordBatch, column: int, limit: int = MADE_BYTES):
    """batch in runs of rows with at most limit bytes in a column of strings, or one row that has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n + 100  # a row takes some itself
    if at < batch.num_rows:
        yield batch.slice(at)


def made(batches, kept: int, added: list, make):
    """batches: kept columns and a text. Yields the kept columns and those that make gives of each text, a piece at a time."""
    C.trimmed()
    for batch in batches:
        for piece in pieces(batch, kept):
            rows = [make(x or "") for x in piece.column(kept).to_pylist()]
            columns = [*piece.columns[:kept], *[pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(added)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f"_{i}" for i in range(kept)], *[n for n, _, _ in added]])


def _mapped(docs: DataFrame, text: str, added: list, make) -> DataFrame:
    """docs with columns replaced or added: make(text) gives their values."""
    names = [n for n, _, _ in added]
    kept = [f for f in docs.schema if f.name not in names]
    source = docs.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(kept)], F.col(text).alias("_text"))

    schema = ", ".join([*[f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)], *[f"`{n}` {s}" for n, s, _ in added]])
    out = source.mapInArrow(lambda batches: made(batches, len(kept), added, make), schema)
    return out.select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(kept)], *names)


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """docs with spans: kind, start and end (code points, end exclusive) of every secret."""
    field = field or learn(docs, id_col, text)
    make = lambda t: ([{"kind": k, "start": s, "end": e} for s, k, e, _ in found(t, field)],)
    return _mapped(docs, text, [("spans", SPANS, _SPANS)], make)


def redacted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mark: str = "[SECRET]", field: Field | None = None) -> DataFrame:
    """docs with every secret in text replaced by mark; null text becomes empty; other columns as they are."""
    field = field or learn(docs, id_col, text)

    def make(value):
        out, at = [], 0
        for _, _, end, own in found(value, field):
            if end > at:
                out += [value[at : max(own, at)], mark]
                at = end
        return ("".join([*out, value[at:]]),)

    done = _mapped(docs, text, [(text, "string", pa.string())], make)
    return done.select(*[f"`{c}`" for c in docs.columns])
