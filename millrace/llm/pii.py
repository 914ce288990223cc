"""Personal data by patterns and a character-level tagger.

Patterns give the base spans. A bidirectional LSTM over characters with CRF
transitions adds spans that the patterns don't allow for, such as addresses
with a spelt "at" or numbers with unusual separators. It is trained in numpy by
``train``, on generated text with labelled spans, from a fixed seed; its weights,
some fifteen thousand numbers, lie beside this module, as ``python -m
millrace.llm.pii`` writes them.

A finding counts only if it has the shape of its kind, and whatever has one
holds a digit, an at sign, a bracketed "at" or a bare "at" with a host behind it,
dotted or with a spelt "dot". The text around these is covered by overlapping
windows, which are decoded in batches; text without any needs no window. The windows' findings
are reconciled for the whole text: what touches an inner window edge counts
only if no other window sees it whole, overlapping findings of a kind are
joined, an address is widened to the whole of its name and host however long
these are, findings must have the shape of their kind, and base spans win over
findings that they overlap.

Defined cases: a null text counts as empty and has no spans; a very long text is
read whole, a window at a time; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.arrow import kept, map_batches, slices, texts_of
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
#: Window and its step in code points, reach of a trigger, windows decoded at once.
WINDOW, STEP, REACH, LANES = 96, 48, 40, 512
#: Size of character vectors and of each direction's state, rounds and windows of training, seed.
VECTOR, HIDDEN, ROUNDS, LOT, SEED = 12, 32, 1500, 64, 7
#: The trained weights and the digest of their numbers.
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
DIGEST = "68842fa197efbc56b5b81cbf050c0bbed3fd9c6bbee8279ffb0efbfa45dec4b1"

# ---------------------------------------------------------------- base spans

# The base patterns. Each is applied so that a long text takes linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LABELS = re.compile(r"[A-Za-z0-9-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind as KINDS lists them, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


# ------------------------------------------------------------ labelled text

#: Forms of each kind: {u} a name, {d} a host's part, {t} its end, {i} a number to 255, {4} so many digits, {A} to {S} one of SIGNS throughout the form.
_TEMPLATES = {
    "email": ("{u}{A}{d}{D}{t}", "{u}{A}{d}{D}{t}", "{u}{A}{d}{D}{t}", "{u}{A}{d}.{t}", "{u} at {d}{D}{t}", "{u} at {d} dot {t}", "{u} at {d} dot {t}", "{u}{A}{d}-{d}.{t}", "{u}@ {d}.{t}", "{u} AT {d} DOT {t}", "{u}{A}{d}{D}{d}{D}{t}", "{u}@{d}.{t}", "{u} @ {d}.{t}"),
    "ip": ("{i}{I}{i}{I}{i}{I}{i}", "{i}{I}{i}{I}{i}{I}{i}", "{i}.{i}.{i}.{i}"),
    "card": ("{4}{C}{4}{C}{4}{C}{4}", "{4}{C}{4}{C}{4}{C}{4}", "{4}{C}{6}{C}{5}", "{4}{C}{4}{C}{4}{C}{4}{C}{3}"),
    "phone": (
        "({3}) {3}-{4}", "({3}) {3} {4}", "({3}){3}-{4}", "({4}) {6}", "({3}){S}{3}{S}{4}", "{3}{S}{3}{S}{4}", "{4}{S}{3}{S}{3}", "{4}{S}{7}", "{5}{S}{6}", "{3}{S}{4}{S}{4}", "{2}{S}{4}{S}{4}", "{2}{S}{2}{S}{2}{S}{2}{S}{2}",
        "0{3}{S}{7}", "00{2} {3} {3} {4}", "00{2}{S}{3}{S}{3}{S}{4}", "00{2}{S}{2}{S}{7}", "00{2}{S}{3}{S}{6}", "(00{2}) {2} {7}", "(00{2}){S}{3}{S}{6}", "{4}{S}{3} {4}", "{3} {3} {2} {2}", "0{2} {3} {2} {2} {2}", "+1 ({3}) {3}-{4}", "+{2} {3} {3} {4}", "+{2}{S}{2}{S}{4}{S}{4}", "+{2} (0) {3} {6}",
    ),
}
#: What stands between the parts of a form.
SIGNS = {
    "A": ("(at)", " (at) ", "[at]", " [at] ", "( at )", " ( at ) ", "[ at ]", " [ at ] ", " at ", " AT ", " At ", " @ ", "@", " (AT) ", " [AT] ", "[AT]", "@ ", "{at}", " {at} ", "<at>", " <at> "),
    "D": (".", ".", "(dot)", " (dot) ", "[dot]", " [dot] ", "( dot )", " ( dot ) ", "[ dot ]", " [ dot ] ", " dot ", " DOT ", " Dot ", " [DOT] ", " (DOT) ", "{dot}", " {dot} ", "<dot>", " <dot> "),
    "I": (".", " . ", "[.]", "(.)", " [.] ", " dot ", " DOT ", "[dot]", "(dot)", " [dot] ", ". ", " .", "(.) ", "<.>", "{dot}", " / "),
    "C": (".", "/", "_", "  ", "   ", " . ", ":", " / ", "--", "|", ",", " - "),
    "S": (" ", "-", ".", "/", " - ", " / "),
}
#: Text that looks near to personal data and is none.
_OTHERS = ('token = "{x}"', "{x}", "{4}", "{2}", "{3}", "{i}.{i}", "{i}.{i}.{2}", "{4}-{2}-{2}", "{2}/{2}/{4}", "{2}:{2}", "{4}{4}{4}{4}", "{4}{4}{4}{4} {4}{4}{4}{4}", "{3},{3}", "${4}", "{2}%", "{w} at {w}", "{w} dot {w}", "{w} at {2}", "{w} at {w} {w}", "{w} at {w}. {w}", "{w} (at {w})", "({w}) {w}", "[{w}] {w}", "{w}.{w}", "@{w}", "{w} @ {w}", "v{i}.{i}", "({4})", "({2}) {w}", "{w}{2}", "[{2}]", "{3}-{2}", "{3}{S}{2}{S}{2}", "{4}{S}{4}", "{2}{S}{2}{S}{2}", "{i}{I}{i}{I}{i}", "{4}{C}{4}", "{4}{C}{4}{C}{4}{C}{4}{C}{4}{C}{4}", "{w}{D}{w}", "{w}{A}{w}", "{w} at {w} dot", "{w} dot com", "{2}{S}{w}", "No. {6}", "{6}")
_VOWELS, _OTHER_LETTERS = "aeiouéäö", "bcdfghklmnprstvwz"


def _fill(rng: np.random.Generator, form: str) -> str:
    chosen = {k: signs[rng.integers(len(signs))] for k, signs in SIGNS.items()}

    def one(m: re.Match) -> str:
        c = m[1]
        if c in chosen:
            return chosen[c]
        if c.isdigit():
            return "".join(map(str, rng.integers(0, 10, int(c))))
        if c == "i":
            return str(rng.integers(0, 256))
        if c == "x":
            return "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, rng.integers(24, 41)))
        if c == "t":
            ends = ("com", "org", "net", "de", "fr", "example.com", "co.uk", "edu", "io", "info", "es", "gov", "ac.uk", "eu")
            return ends[rng.integers(len(ends))]
        word = _name(rng) if c in "ud" and rng.random() < 0.6 else _word(rng)
        if c == "u" and (draw := rng.random()) < 0.7:
            word += (".", "_", "", "-")[rng.integers(4)] + (str(rng.integers(0, 100)) if draw < 0.35 else _name(rng))
        if c == "u" and rng.random() < 0.06:
            word += "".join((".", "-", "_", "")[rng.integers(4)] + _name(rng) for _ in range(rng.integers(3, 9)))
        if c == "d" and rng.random() < 0.2:
            word += "-" + _name(rng)
        return word.capitalize() if rng.random() < 0.1 else word

    return re.sub(r"\{(.)\}", one, form)


def _word(rng: np.random.Generator) -> str:
    return "".join(_OTHER_LETTERS[rng.integers(len(_OTHER_LETTERS))] + _VOWELS[rng.integers(len(_VOWELS))] for _ in range(rng.integers(1, 5)))


def _name(rng: np.random.Generator) -> str:
    """Letters of the whole alphabet, a vowel at least every third."""
    letters = rng.integers(0, 26, rng.integers(2, 10))
    vowels = rng.integers(0, 5, len(letters))
    first = rng.integers(3)
    return "".join("aeiou"[v] if (k + first) % 3 == 0 else chr(97 + c) for k, (c, v) in enumerate(zip(letters.tolist(), vowels.tolist(), strict=True)))


def labelled(rng: np.random.Generator, size: int = WINDOW) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of the size and its labelled spans."""
    text, spans = "", []
    while len(text) < size:
        draw = rng.random()
        if draw < 0.22:
            kind = KINDS[rng.integers(4)]
            form = _TEMPLATES[kind][rng.integers(len(_TEMPLATES[kind]))]
            filled = _fill(rng, form)
            if len(text) + len(filled) > size:
                break
            spans.append((kind, len(text), len(text) + len(filled)))
            text += filled
        elif draw < 0.42:
            text += _fill(rng, _OTHERS[rng.integers(len(_OTHERS))])
        else:
            word = _word(rng) if rng.random() < 0.7 else _name(rng)
            text += word.upper() if rng.random() < 0.08 else word.capitalize() if rng.random() < 0.2 else word
        text += (" ", " ", " ", " ", ", ", ". ", "!! ", "\n", "### ", " | ")[rng.integers(10)]
    return text[:size].ljust(size), spans


# -------------------------------------------------------------------- model

_CHARS = "abcdefghijklmnopqrstuvwxyz0A .-+()@_%[]/\n,:\"'#$"
_OTHER_LETTER, _OTHER = len(_CHARS) + 1, len(_CHARS) + 2
SYMBOLS, TAGS = len(_CHARS) + 3, 1 + 2 * len(KINDS)  # symbol 0 pads; tag 0 is outside, 2k + 1 begins kind k, 2k + 2 continues it


def symbols(text: str) -> np.ndarray:
    """Symbol of each character: digits are one, as capitals are."""
    table = kept("pii symbols", _symbol_table)
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(table) - 1)]


def _symbol_table() -> np.ndarray:
    out = np.full(0x3000, _OTHER, np.int64)
    for i in range(len(out)):
        c = chr(i)
        if c in _CHARS:
            out[i] = _CHARS.index(c) + 1
        elif "0" <= c <= "9":
            out[i] = _CHARS.index("0") + 1
        elif "A" <= c <= "Z":
            out[i] = _CHARS.index("A") + 1
        elif c.isalpha():
            out[i] = _OTHER_LETTER
        elif c.isspace():
            out[i] = _CHARS.index(" ") + 1
    return out


def _allowed() -> np.ndarray:
    """-1e4 for tag pairs that can't follow each other, else 0."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for a in range(TAGS):
        for b in range(2, TAGS, 2):
            if a not in (b - 1, b):
                out[a, b] = -1e4
    return out


class Tagger:
    """BiLSTM-CRF; arrays are (time, lane, ...)."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            rng = np.random.default_rng(SEED)
            weights = {"e": rng.normal(0, 0.3, (SYMBOLS, VECTOR)), "o": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
            for d in "fb":
                weights |= {f"w{d}": rng.normal(0, 0.2, (VECTOR + HIDDEN, 4 * HIDDEN)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def _read(self, x: np.ndarray, tape: list | None) -> np.ndarray:
        """States of both directions, the backward one on the reversed text, in one go: (time, lane, 2 * HIDDEN)."""
        w, b = (np.stack([self.w[f"{k}f"], self.w[f"{k}b"]]) for k in "wb")
        steps, lanes = x.shape[:2]
        fed = np.stack([x, x[::-1]], 1) @ w[:, :VECTOR] + b[:, None]
        own = w[:, VECTOR:]
        h = c = np.zeros((2, lanes, HIDDEN), x.dtype)
        out = np.empty((steps, 2, lanes, HIDDEN), x.dtype)
        for t in range(steps):
            z = fed[t] + h @ own
            gates = 1 / (1 + np.exp(-z[:, :, : 3 * HIDDEN]))
            i, f, o = gates[:, :, :HIDDEN], gates[:, :, HIDDEN : 2 * HIDDEN], gates[:, :, 2 * HIDDEN :]
            g = np.tanh(z[:, :, 3 * HIDDEN :])
            before, old = h, c
            c = f * c + i * g
            y = np.tanh(c)
            h = o * y
            out[t] = h
            if tape is not None:
                tape.append((t, before, old, i, f, o, g, y))
        return np.concatenate([out[:, 0], out[::-1, 1]], 2)

    def _read_back(self, x: np.ndarray, tape: list, up: np.ndarray, grad: dict) -> np.ndarray:
        w = np.stack([self.w["wf"], self.w["wb"]])
        feed, own = w[:, :VECTOR].transpose(0, 2, 1), w[:, VECTOR:].transpose(0, 2, 1)
        both = np.stack([x, x[::-1]], 1)
        up = np.stack([up[:, :, :HIDDEN], up[::-1, :, HIDDEN:]], 1)
        dx = np.empty_like(both)
        dh = dc = np.zeros((2, x.shape[1], HIDDEN), x.dtype)
        gw, gb = np.zeros_like(w), np.zeros((2, 4 * HIDDEN), x.dtype)
        for t, before, old, i, f, o, g, y in reversed(tape):
            dh = dh + up[t]
            dc = dc + dh * o * (1 - y * y)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * y * o * (1 - o), dc * i * (1 - g * g)], 2)
            gw += np.concatenate([both[t], before], 2).transpose(0, 2, 1) @ dz
            gb += dz.sum(1)
            dx[t], dh, dc = dz @ feed, dz @ own, dc * f
        for k, d in enumerate("fb"):
            grad[f"w{d}"], grad[f"b{d}"] = gw[k], gb[k]
        return dx[:, 0] + dx[::-1, 1]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        x = self.w["e"][codes]
        return self._read(x, None) @ self.w["o"] + self.w["ob"]

    def learn(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean loss of a lot of windows and its gradient."""
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        x = self.w["e"][codes]
        tape: list = []
        both = self._read(x, tape)
        em = both @ self.w["o"] + self.w["ob"]
        steps, lanes = codes.shape
        move = self.w["t"] + _allowed()
        # forward and backward sums of each step, scaled so that they sum to 1
        top = em.max(2, keepdims=True)
        here, moves = np.exp(em - top), np.exp(move)
        alpha, beta, scale = np.empty_like(em), np.ones_like(em), np.empty((steps, lanes, 1), em.dtype)
        for t in range(steps):
            now = here[t] * (np.exp(_allowed()[0]) if t == 0 else alpha[t - 1] @ moves)  # a window begins as after an outside tag
            scale[t] = now.sum(1, keepdims=True)
            alpha[t] = now / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (here[t + 1] * beta[t + 1] / scale[t + 1]) @ moves.T
        whole = (np.log(scale) + top).sum((0, 2))
        lane, time = np.arange(lanes), np.arange(steps)
        gold = em[time[:, None], lane, tags].sum(0) + move[tags[:-1], tags[1:]].sum(0)
        d_em = alpha * beta
        d_em[time[:, None], lane, tags] -= 1
        pairs = moves * np.tensordot(alpha[:-1], here[1:] * beta[1:] / scale[1:], ((0, 1), (0, 1)))
        np.subtract.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        d_em /= lanes
        grad["t"], grad["ob"] = pairs / lanes, d_em.sum((0, 1))
        grad["o"] = np.tensordot(both, d_em, ((0, 1), (0, 1)))
        up = d_em @ self.w["o"].T
        dx = self._read_back(x, tape, up, grad)
        np.add.at(grad["e"], codes, dx)
        return float((whole - gold).mean()), grad

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags of each lane by Viterbi."""
        em = self.emissions(codes)
        move = self.w["t"] + _allowed().astype(em.dtype)
        best, back = em[0] + _allowed()[0].astype(em.dtype), np.empty(em.shape, np.int8)
        for t in range(1, len(em)):
            ways = best[:, :, None] + move
            back[t] = ways.argmax(1)
            best = ways.max(1) + em[t]
        tags = np.empty(codes.shape, np.int64)
        tags[-1] = best.argmax(1)
        lane = np.arange(codes.shape[1])
        for t in range(len(em) - 1, 0, -1):
            tags[t - 1] = back[t][lane, tags[t]]
        return tags


def digest(weights: dict[str, np.ndarray]) -> str:
    """A digest of the numbers, by name."""
    return hashlib.sha256(b"".join(k.encode() + np.ascontiguousarray(weights[k], "<f4").tobytes() for k in sorted(weights))).hexdigest()


def weights() -> dict[str, np.ndarray]:
    """The trained weights; an error if they are not those that belong to this module."""
    with np.load(WEIGHTS) as found:
        out = {k: found[k] for k in found.files}
    if digest(out) != DIGEST:
        raise ValueError("pii_weights.npz is not what was trained: run python -m millrace.llm.pii")
    return out


def train(rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after Adam on generated windows, always the same."""
    rng = np.random.default_rng(SEED)
    tagger = Tagger()
    first, second = ({k: np.zeros_like(v) for k, v in tagger.w.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        lot = [labelled(rng) for _ in range(LOT)]
        codes = np.stack([symbols(t) for t, _ in lot], 1)
        tags = np.zeros(codes.shape, np.int64)
        for lane, (_, spans) in enumerate(lot):
            for kind, a, b in spans:
                tags[a, lane], tags[a + 1 : b, lane] = 2 * KINDS.index(kind) + 1, 2 * KINDS.index(kind) + 2
        _, grad = tagger.learn(codes, tags)
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            tagger.w[k] = tagger.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return tagger.w


# ------------------------------------------------------------ whole texts

#: A host and its dots, plain or spelt, and a spelt at sign, as in the shape of an address.
_HOST = r"[a-z0-9-]+(?:(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)[a-z0-9-]+)+"
_AT = r"[(\[{<]\s?at\s?[)\]}>]"
_REST = re.compile(r"[A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)*+")
#: What every finding of the shape of a kind holds, see shaped().
_TRIGGER = re.compile(rf"[0-9@]|{_AT}|\sat\s{_HOST}", re.IGNORECASE)


def windows(text: str) -> list[int]:
    """Starts of overlapping windows that cover all text within REACH of a trigger."""
    out: list[int] = []
    covered = 0  # up to here
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if not out or lo > covered:
            out.append(lo)
            covered = lo + WINDOW
        while covered < hi:
            out.append(out[-1] + STEP)
            covered = out[-1] + WINDOW
    return out


#: A name, an at sign or a spelt one, and a host with dots or spelt ones.
_EMAIL = re.compile(rf"[a-z0-9][a-z0-9._%+-]*(?:\s?@\s?|\s?{_AT}\s?|\sat\s){_HOST}$", re.IGNORECASE)


def shaped(kind: str, text: str) -> bool:
    """Whether a finding can be of its kind at all."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        return bool(_EMAIL.match(text))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", text) and text[0] in "+(0123456789" and bool(re.search(r"[^0-9]", text))


def found_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """The tagger's findings in each text, reconciled over its windows."""
    places = [(k, at) for k, t in enumerate(texts) for at in windows(t)]
    raw: list[list[tuple[str, int, int, bool]]] = [[] for _ in texts]
    for lot in range(0, len(places), LANES):
        part = places[lot : lot + LANES]
        codes = np.zeros((WINDOW, len(part)), np.int64)
        for lane, (k, at) in enumerate(part):
            own = symbols(texts[k][at : at + WINDOW])
            codes[: len(own), lane] = own
        tags = tagger.decode(codes)
        for lane in np.flatnonzero(tags.any(0)).tolist():
            k, at = part[lane]
            line, t = tags[:, lane].tolist(), 0
            size = min(WINDOW, len(texts[k]) - at)
            while t < size:
                tag = line[t]
                if tag % 2:
                    end = t + 1
                    while end < size and line[end] == tag + 1:
                        end += 1
                    whole = (t > 0 or at == 0) and (end < size or at + size == len(texts[k]))
                    raw[k].append((KINDS[tag // 2], at + t, at + end, whole))
                    t = end
                else:
                    t += 1
    return [reconcile(own, t) for own, t in zip(raw, texts, strict=True)]


def widened(spans: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """The spans, of which an address goes on to the start of its name and the end of its host; those that then meet are one."""
    out: list[tuple[str, int, int]] = []
    run = (0, -1)  # the run of name signs looked at last
    for kind, a, b in spans:
        if kind == "email":
            if not run[0] <= a <= run[1]:
                start = a
                while start and _LOCAL.match(text[start - 1]):
                    start -= 1
                run = start, a
            a, b = run[0], _REST.match(text, b).end() if b and text[b - 1].isalnum() else b
            run = run[0], max(run[1], b)
            while a < b and not text[a].isalnum():
                a += 1
            if out and out[-1][0] == kind and a < out[-1][2]:
                a, b = out[-1][1], max(b, out[-1][2])
                out.pop()
        out.append((kind, a, b))
    return out


def reconcile(raw: list[tuple[str, int, int, bool]], text: str) -> list[tuple[str, int, int]]:
    """Findings of overlapping windows as spans of the whole text."""
    seen = sorted({(kind, a, b) for kind, a, b, whole in raw if whole})
    for kind, a, b, whole in sorted(set(raw)):
        if not whole and not any(k == kind and x < b and a < y for k, x, y in seen):
            seen.append((kind, a, b))
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(seen):
        if out and out[-1][0] == kind and a < out[-1][2]:
            out[-1] = (kind, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    out = [(kind, a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for kind, a, b in out]
    return [(kind, a, b) for kind, a, b in widened([x for x in out if x[2] > x[1]], text) if shaped(kind, text[a:b])]


def merge(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the findings that overlap none of them, by kind as listed, then start."""
    added = [f for f in found if not any(f[1] < b and a < f[2] for _, a, b in base)]
    return sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the number of base spans of each kind, base_sha256, spans, n_added of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    trained = kept("pii weights", weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(trained)
        for batch in slices(batches, 1):
            texts = texts_of(batch.column(1))
            base = [base_spans(t) for t in texts]
            spans = [merge(b, f) for b, f in zip(base, found_spans(texts, tagger), strict=True)]
            numbers = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            hashes = pa.array([hashlib.sha256(digest_of(b).encode()).hexdigest() for b in base], pa.string())
            added = pa.array([len(s) - len(b) for s, b in zip(spans, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, hashes, pa.array(map(digest_of, spans), pa.string()), added], names=["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    out = map_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), run, schema)
    return out.withColumnRenamed("_id", id_col)


def op9_pii(spark, sf_dir):
    from millrace.runtime import table

    return find(table(spark, sf_dir, "documents"))


if __name__ == "__main__":
    trained = train()
    np.savez(WEIGHTS, **trained)
    print("DIGEST =", repr(digest(trained)))
