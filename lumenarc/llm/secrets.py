"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens.

Three patterns give the base spans. The field tags every whitespace token as outside, begin or inside of a secret
from its shape, its neighbours and its document, decoded by Viterbi over whole lines. It is trained here, on lines made
by rule from a fixed seed, by maximum likelihood. Spans that the field finds outside the base spans are added; base
spans stay.

Nulls: a null text is empty and has no spans. Repeated rows give repeated results; long texts are scanned whole;
an empty table gives no rows. Ties between tags go to the lower tag. scan() doesn't read
extra columns, redacted() keeps them, whatever their type and name.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm import kernels as K
from lumenarc.llm.common import map_batches

#: Fixed patterns; a match of `assign` counts if its second group has MIN_ASSIGNED characters.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
MIN_ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
#: Cells of one walk of the decoder: lines of like length are walked together, a very long one alone.
CELLS = 1 << 22
MASK = "[SECRET]"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_ASSIGNED = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_PHRASE = (b"passphrase", b"pass_phrase", b"mnemonic", b"recovery phrase", b"seed phrase")
_KEYWORDS = (*_ASSIGNED, *_PHRASE, b"pwd", b"credential", b"private_key", b"access_key", b"secret_key", b"signing_key", b"bearer")
#: Words of a phrase that a keyword opens, at most so far behind it.
PHRASE = 12


def _of(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), list(chars.encode()))


_DIGIT, _UPPER, _LOWER = _of("0123456789"), _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("abcdefghijklmnopqrstuvwxyz")
_HEX, _ANY_HEX = _of("0123456789abcdef"), _of("0123456789abcdefABCDEF")
_WEB, _DOT, _KEYISH, _SLASH, _HYPHEN, _LOWLINE, _COLON, _AT = map(_of, ("@:?", ".", "+/_=-", "/\\", "-", "_", ":", "@"))
_VOWEL, _CLOSE, _NOISE = _of("aeiouyAEIOUY"), _of(".;,!?\"')]}>"), _of(".,!#*$%&'\"")
#: Heads of keys by the services that give them out; fixed values.
_HEADS = (b"AKIA", b"sk_", b"sk-", b"pk_", b"ghp_", b"xoxb-", b"glpat-", b"npm_", b"SG.", b"eyJ")
_WIDE = np.arange(256) >= 128
_KIND = np.where(_DIGIT, 1, np.where(_UPPER, 2, np.where(_LOWER | _WIDE, 3, 4))).astype(np.int8)
FEATURES = 44


def _places(data: bytes, words: tuple[bytes, ...]) -> np.ndarray:
    """Where each of words begins in data."""
    out = []
    for word in words:
        at = data.find(word)
        while at >= 0:
            out.append(at)
            at = data.find(word, at + 1)
    return np.array(out, np.int64)


def features(chunk: K.Chunk, ws: np.ndarray, we: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """FEATURES numbers, 0 or 1, of each token.

    Its shape: length, kinds of characters, how often they turn, whether its letters can be spoken (a consonant before a
    vowel), the longest stretch without punctuation, and the forms of addresses, paths and UUIDs. Its neighbours: keywords
    and signs of assignment before it, and a phrase that such a keyword opens and nothing has closed. Its file: the
    document's shares of digits, of words that assign and of lines that begin with a name and a sign.
    """
    buf, n = chunk.buf, len(ws)
    size = we - ws

    def total(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])

    def count(table: np.ndarray) -> np.ndarray:
        t = total(table[buf])
        return t[we] - t[ws]

    def holding(places: np.ndarray) -> np.ndarray:
        """Tokens in which one of the places lies."""
        out = np.zeros(n, bool)
        if n and len(places):
            out[np.maximum(np.searchsorted(ws, places, "right") - 1, 0)] = True
        return out

    digit, upper, lower, hexes, any_hex, web, dots, keyish, wide = map(count, (_DIGIT, _UPPER, _LOWER, _HEX, _ANY_HEX, _WEB, _DOT, _KEYISH, _WIDE))
    slash, hyphen, lowline, colon, at_sign, noise = map(count, (_SLASH, _HYPHEN, _LOWLINE, _COLON, _AT, _NOISE))
    kind = _KIND[buf]
    turn = np.concatenate([[0], total(kind[1:] != kind[:-1])])
    turns = turn[we] - turn[np.minimum(ws + 1, we)]
    spoken = np.concatenate([[0], total((_LOWER | _UPPER)[buf[:-1]] & ~_VOWEL[buf[:-1]] & _VOWEL[buf[1:]])])
    spoken = spoken[we] - spoken[np.minimum(ws + 1, we)]
    edge = np.diff(np.concatenate([[0], (kind != 4).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stretch = np.zeros(n, np.int64)
    if n and len(begin):  # a stretch lies in one token, as blanks end it
        np.maximum.at(stretch, np.maximum(np.searchsorted(ws, begin, "right") - 1, 0), end - begin)
    low = K.LOWER[buf].tobytes()
    key, phrase, url = holding(_places(low, _KEYWORDS)), holding(_places(low, _PHRASE)), holding(_places(low, (b"://", b"www.")))
    headed = holding(_places(buf.tobytes(), _HEADS))
    sign = buf[we - 1]
    assigns = (sign == ord("=")) | (sign == ord(":"))
    line = total(buf == K.LF)[ws] if n else ws

    def shift(x: np.ndarray, k: int) -> np.ndarray:
        """x of the token k places before, of the same text."""
        k = min(k, n)
        return np.concatenate([np.zeros(k, bool), x[: n - k]]) & (np.concatenate([np.full(k, -1), owner[: n - k]]) == owner)

    place = np.arange(n)
    opens = (phrase | shift(phrase, 1)) & assigns
    last = np.maximum.accumulate(np.where(opens, place, -1)) if n else place
    after = place - np.maximum(last, 0)
    closed = total(_CLOSE[sign])
    in_phrase = (last >= 0) & (after > 0) & (after <= PHRASE) & (line == line[np.maximum(last, 0)]) & (closed[place] == closed[np.minimum(last + 1, n)]) if n else np.zeros(0, bool)
    letters = upper + lower
    plain = size - digit - letters - keyish - noise
    varied = (digit > 0).astype(int) + (upper > 0) + (lower > 0)
    uuid = (hyphen == 4) & (any_hex >= 32) & (any_hex <= 36) & (size <= 44)
    sums = lambda weights: np.bincount(owner, weights=weights, minlength=len(chunk))
    heads = np.concatenate([[True], line[1:] != line[:-1]]) if n else np.zeros(0, bool)
    named = heads & (assigns | np.concatenate([assigns[1:] & (size[1:] == 1), [False]])) if n else heads
    digits_file, config_file, signs_file = sums(digit) * 20 > sums(size), sums(named) * 2 > sums(heads), sums(assigns) * 10 > sums(np.ones(n))
    columns = [
        np.ones(n, bool), size < 8, (size >= 8) & (size < 12), (size >= 12) & (size < 16), (size >= 16) & (size < 24), size >= 24,
        digit > 0, digit * 5 >= size, digit == size, varied >= 2, varied == 3, turns >= 4, turns >= 7,
        (hexes >= size - 2) & (size >= 12), plain <= 1, web > 0, dots >= 2, wide > 0, keyish > 0,
        digit >= 15, key, shift(key, 1) & ~shift(assigns, 1), shift(key & assigns, 1), shift(key, 2) & shift(assigns, 1), digits_file[owner],
        (letters >= 8) & (spoken * 4 >= letters), (letters >= 8) & (spoken * 3 >= letters), turns * 2 >= size, stretch >= 12, stretch >= 20, uuid,
        url, url & (at_sign > 0) & (colon >= 2), slash >= 3, hyphen + lowline >= 2, (spoken * 4 < letters) & (varied == 3) & (stretch >= 16),
        in_phrase & (after == 1), in_phrase & (after > 1), in_phrase & (digit + plain > 2), config_file[owner], signs_file[owner], letters == size,
        headed & (stretch >= 12), (digit >= 14) & (digit + noise == size),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _training_documents(n: int = 1500, seed: int = 7) -> list[list[list[tuple[str, int]]]]:
    """Documents of lines of (token, tag), n lines in all, made by rule; tags: 0 outside, 1 begin, 2 inside.

    Kinds of files: settings, logs, prose and lines of anything. Beside secrets stand what is easily taken for one:
    addresses, paths, UUIDs, names of products, identifiers, versions and words after a keyword.
    """
    r = random.Random(seed)
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    said = lambda a, b: "".join(r.choice(["", "", "s", "t", "r"]) + r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(["", "", "n", "r", "l"]) for _ in range(r.randint(a, b)))
    noise = lambda: r.choice(["", "", "", ",", ".", "!!", "###", "***", "$$$", "%%%", "&&&", ",###", ".***"])
    word = lambda: r.choice([lambda: said(1, 5), lambda: some(low + "éèüñ" * r.randint(0, 1), 1, r.choice([6, 10, 14, 30]))])() + noise()
    number = lambda: some(dig, 1, 4)
    uuid = lambda: (str.upper if r.random() < 0.2 else str)("-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)))
    host = lambda: f"{said(1, 3)}.{r.choice(['example.com', 'example.org', 'test', 'co.uk', 'io'])}"
    piece = lambda: r.choice([lambda: said(1, 4), number, lambda: some(low + up + dig, 4, 30), lambda: said(1, 2).capitalize() + said(1, 3).capitalize() + number(), uuid])()
    url = lambda: r.choice(["https://", "http://", "ftp://", "www."]) + host() + "".join("/" + piece() for _ in range(r.randint(0, 4))) + r.choice(["", "", "?ref=" + piece(), "?id=" + piece() + "&page=" + number(), "#" + said(1, 3), ".html"])
    product = lambda: "".join(r.choice([said(1, 3).capitalize(), said(1, 2), number(), some(up, 1, 2)]) for _ in range(r.randint(3, 7)))
    path = lambda: r.choice(["/", "~/", "./", "C:\\"]) + "/".join(r.choice([said(1, 4), said(1, 2) + number(), said(1, 2) + "-" + number() + "." + number()]) for _ in range(r.randint(3, 7))) + r.choice(["", ".so", ".py", ".tar.gz"])
    identifier = lambda: r.choice(["_", "-"]).join(r.choice([said(1, 3), number(), said(1, 2) + number()]) for _ in range(r.randint(3, 6)))
    version = lambda: f"{said(1, 3)}-{some(dig, 1, 2)}.{some(dig, 1, 2)}.{some(dig, 1, 2)}{r.choice(['', '-rc1', '+build7', '-SNAPSHOT'])}"
    stamp = lambda: f"{some(dig, 4, 4)}-{some(dig, 2, 2)}-{some(dig, 2, 2)}T{some(dig, 2, 2)}:{some(dig, 2, 2)}"
    mail = lambda: f"{some(low, 3, 8)}.{some(dig, 1, 3)}@{some(low, 4, 8)}{some(dig, 1, 2)}.example.com"
    lookalike = [url, url, uuid, product, product, path, identifier, lambda: identifier().upper(), version, lambda: product() + "." + product() + "()"]
    plain = [
        word, word, word, word, word, word, lambda: word().capitalize(), lambda: word().upper() + "!!", lambda: some(dig, 1, 13) + noise(), lambda: ".".join(some(dig, 1, 3) for _ in range(4)),
        mail, lambda: r.choice(lookalike)() + noise(), lambda: r.choice(lookalike)(), lambda: "-".join(some(dig, 3, 4) for _ in range(3)), stamp, lambda: some(low, 4, 8) + "-" + some(low, 4, 8), lambda: r.choice(["token", "secret", "password", "passphrase", "|", "="]),
    ]
    secret = [
        lambda: some(low + up + dig, 16, 44), lambda: some(hexa, 16, 64), lambda: some(dig, 16, 24), lambda: some(low + up + dig + "+/", 24, 60) + r.choice(["", "=", "=="]), lambda: "AKIA" + some(up + dig, 14, 18),
        lambda: r.choice(["sk-", "sk_live_", "ghp_", "xoxb-", "glpat-", "pk_test_", "npm_", "SG."]) + some(low + up + dig, 16, 36), lambda: ".".join("ey" * (k < 2) + some(low + up + dig + "_-", 12, 40) for k in range(3)), lambda: some(up + dig, 16, 28),
        lambda: f"{r.choice(['postgres', 'mysql', 'amqp', 'redis', 'https'])}://{said(1, 3)}:{some(low + up + dig, 6, 16)}@{host()}{r.choice(['', ':' + number(), '/' + said(1, 2)])}",
    ]
    named = ["password", "passwd", "secret", "token", "api_key", "apikey", "credential", "access_key", "pwd", "secret_key", "signing_key"]
    phrased = ["passphrase", "pass_phrase", "PASSPHRASE", "ssh_passphrase", "mnemonic"]
    short = lambda: some(low + up + dig + "_.-", 8, 14) + some(dig, 1, 2)
    weak = lambda: r.choice([str, str.capitalize])(said(2, 4)) + some(dig, 1, 4) + r.choice(["", "!", "#", "$"])
    quoted = lambda value: r.choice(['"{}"', "'{}'", "{}", "{}", "{},", "{}."]).format(value)
    dull = lambda: r.choice([lambda: r.choice(["true", "false", "none", "null", "required", "optional", "enabled", "expired", "****", "<redacted>", "***", "yes", "n/a"]), lambda: said(1, 3), number])()

    def phrase() -> list[tuple[str, int]]:
        words = [r.choice([lambda: said(1, 3), lambda: some(low, 3, 8)])() for _ in range(r.randint(3, 12))]
        mark = r.choice(['"', "'", "", "", ""])
        words[0], words[-1] = mark + words[0], words[-1] + mark
        lead = [(r.choice(phrased) + r.choice(":="), 0)] if r.random() < 0.6 else [(r.choice(phrased), 0), (r.choice(":="), 0)]
        return lead + [(w, 2 if k else 1) for k, w in enumerate(words)]

    def given() -> list[tuple[str, int]]:
        """A secret under its name."""
        value = r.choice([r.choice(secret)() + noise() * (r.random() < 0.3), short(), weak()])
        if r.random() < 0.6:
            return [(r.choice(["", "", said(1, 2) + "_", "export "]).replace(" ", "") + r.choice([str, str.upper])(r.choice(named)) + r.choice(":="), 0), (quoted(value), 1)]
        return [(r.choice([str, str.upper])(r.choice(named)), 0), (r.choice(["=", ":"]), 0), (quoted(value), 1)]

    def setting() -> list[tuple[str, int]]:
        how = r.random()
        if how < 0.15:
            return given()
        if how < 0.22:
            return phrase()
        if how < 0.32:  # a keyword that is given no secret
            return [(r.choice(named + phrased) + r.choice(":="), 0), (dull(), 0)] if r.random() < 0.6 else [(r.choice(named), 0), ("=", 0), (dull(), 0)]
        name = r.choice([identifier, lambda: said(1, 3), lambda: said(1, 2) + "_id"])()
        value = [(quoted(r.choice([*lookalike, dull, dull, number, stamp, mail])()), 0)]
        return [(name + r.choice(":="), 0), *value] if r.random() < 0.6 else [(name, 0), (r.choice("=:"), 0), *value]

    def prose() -> list[tuple[str, int]]:
        line = [((said(1, 5) if r.random() < 0.9 else r.choice(lookalike)()) + r.choice(["", "", "", "", ",", "."]), 0) for _ in range(r.randint(4, 14))]
        if r.random() < 0.2:
            at = r.randint(0, len(line))
            line[at:at] = [(r.choice(named + phrased), 0), (said(1, 4), 0)]
        return [*line, *given()] if r.random() < 0.08 else line

    def log() -> list[tuple[str, int]]:
        line = [(stamp(), 0), (r.choice(["INFO", "WARN", "ERROR", "DEBUG"]), 0)]
        for _ in range(r.randint(1, 5)):
            line.append((r.choice([said, said, said])(1, 4) if r.random() < 0.5 else r.choice([lambda: said(1, 2) + "=" + r.choice(lookalike)(), *lookalike, number])(), 0))
        if r.random() < 0.12:
            line += [("Authorization:", 0), ("Bearer", 0), (r.choice(secret[:1] + secret[5:7])(), 1)] if r.random() < 0.5 else given()
        return line

    def anything() -> list[tuple[str, int]]:
        line = [(r.choice(plain)(), 0) for _ in range(r.randint(2, 14))]
        if r.random() < 0.7:
            at, how, value = r.randint(0, len(line)), r.random(), r.choice(secret)()
            worn = quoted(value) + noise()
            if how < 0.3:
                put = [(r.choice(named) + r.choice(":="), 0), (r.choice([worn, short()]), 1)]
            elif how < 0.5:
                put = [(r.choice(named), 0), (r.choice("=:"), 0), (r.choice([worn, short()]), 1)]
            elif how < 0.6:
                put = [(f"{r.choice(named)}{r.choice('=:')}{value}", 1)]
            elif how < 0.75 and len(value) > 30 and "://" not in value:
                half = r.randint(14, len(value) - 14)
                put = [(value[:half], 1), (value[half:], 2)]
            else:
                put = [(worn, 1)]
            line[at:at] = put
        return line

    out: list[list[list[tuple[str, int]]]] = []
    while n > 0:
        make = r.choice([setting, prose, log, anything, anything])
        out.append([make() for _ in range(min(n, r.choice([1, 1, 3, 6, 12])))])
        n -= len(out[-1])
    return out


def _training_lines(n: int = 1500, seed: int = 7) -> list[list[tuple[str, int]]]:
    """The lines of the training documents."""
    return [line for document in _training_documents(n, seed) for line in document]


@cache
def trained(rounds: int = 300, rate: float = 0.5, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (FEATURES, 3) and transitions (from, to): gradient ascent on the likelihood, forward-backward over all lines at once."""
    documents = _training_documents()
    lines = [line for document in documents for line in document]
    texts = pa.array(["\n".join(" ".join(t for t, _ in line) for line in document) for document in documents])
    rows, width = [], max(map(len, lines))
    for chunk in K.chunks(texts):
        rows.append(features(chunk, *chunk.words()))
    flat = np.concatenate(rows)
    n = len(lines)
    y, mask = np.zeros((n, width), int), np.zeros((n, width), bool)
    for i, line in enumerate(lines):
        y[i, : len(line)], mask[i, : len(line)] = [t for _, t in line], True
    assert mask.sum() == len(flat)
    flat = flat.astype(float)
    w, t = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    barred = np.array([0.0, 0.0, -1e3])  # a sequence doesn't begin inside
    barred_t = np.array([[0.0, 0.0, -1e3], [0, 0, 0], [0, 0, 0]])
    gold = np.eye(3)[y] * mask[..., None]
    gold_w = flat.T @ gold[mask]
    pair = mask[:, 1:]
    gold_t = np.einsum("nta,ntb->ab", gold[:, :-1] * pair[..., None], gold[:, 1:])
    lse = lambda z, axis: (m := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis=axis))
    for _ in range(rounds):
        e, tt = np.zeros((n, width, 3)), t + barred_t
        e[mask] = flat @ w
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = e[:, 0] + barred
        for k in range(1, width):
            alpha[:, k] = np.where(mask[:, k, None], lse(alpha[:, k - 1, :, None] + tt, 1) + e[:, k], alpha[:, k - 1])
        for k in range(width - 2, -1, -1):
            beta[:, k] = np.where(mask[:, k + 1, None], lse(tt + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), beta[:, k + 1])
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pp = np.exp(alpha[:, :-1, :, None] + tt + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[..., None, None]
        gw, gt = (gold_w - flat.T @ p[mask]) / n - decay * w, (gold_t - pp.sum(axis=(0, 1))) / n - decay * t
        gw2, gt2 = gw2 + gw**2, gt2 + gt**2
        w, t = w + rate * gw / np.sqrt(gw2), t + rate * gt / np.sqrt(gt2)
    return w.astype(np.float32), (t + barred_t).astype(np.float32)


def decode(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Viterbi tags of all sequences (first token, tokens), step by step over many sequences at once.

    A sequence whose every token scores so low for begin and inside that no change of tags can pay for it is all
    outside; such sequences, nearly all, are not walked.
    """
    tags = np.zeros(len(emit), np.int8)
    gain = max(0.0, float(trans.max() - trans[0, 0]))
    hot = np.maximum(emit[:, 1], emit[:, 2]) - emit[:, 0] + 2 * gain >= 0
    some = K.crossing_sum(hot, first, first + size) > 0
    first, size = first[some], size[some]
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    while len(first):
        n = max(1, CELLS // int(size[0]))
        _walk(emit, trans, first[:n], size[:n], tags)
        first, size = first[n:], size[n:]
    return tags


def _walk(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, size: np.ndarray, tags: np.ndarray) -> None:
    """Writes the tags of sequences whose sizes do not rise."""
    width = int(size[0])
    back = np.zeros((width, len(first), 3), np.int8)
    score = emit[first] + np.array([0, 0, -1e3], np.float32)
    for k in range(1, width):
        live = int(np.searchsorted(-size, -k, "left"))
        step = score[:live, :, None] + trans
        back[k, :live] = step.argmax(axis=1)
        best = step.max(axis=1) + emit[first[:live] + k]
        score[:live] = best - best.max(axis=1, keepdims=True)  # long lines keep their precision
    best = score.argmax(axis=1).astype(np.int8)
    for k in range(width - 1, -1, -1):
        live = int(np.searchsorted(-size, -k, "left")) if k else len(size)
        tags[first[:live] + k] = best[:live]
        best[:live] = back[k, np.arange(live), best[:live]] if k else best[:live]


def field_spans(chunk: K.Chunk, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end in bytes of the chunk of each secret that the field finds, without quotes and stops around it."""
    ws, we, owner = chunk.words()
    if not len(ws):
        return owner, ws, we
    line = np.cumsum(chunk.buf == K.LF)[ws]
    new = np.concatenate([[True], line[1:] != line[:-1]])
    first = np.flatnonzero(new)
    tags = decode(features(chunk, ws, we, owner) @ weights, trans, first, np.diff(np.append(first, len(ws))))
    begin = np.flatnonzero(tags == 1)
    inside = np.concatenate([tags == 2, [False]])
    end = begin.copy()
    grow = inside[end + 1]
    while grow.any():
        end = end + grow
        grow = grow & inside[end + 1]
    a, b = ws[begin].copy(), we[end].copy()
    rim = np.isin(np.arange(256), list(b"\"'`()[]{}<>,;.:!?*#&$%|"))
    while True:
        left = (a < b) & rim[chunk.buf[np.minimum(a, len(chunk.buf) - 1)]]
        right = (a + left < b) & rim[chunk.buf[b - 1]]
        if not (left | right).any():
            break
        a, b = a + left, b - right
    full = a < b
    return owner[begin[full]], a[full], b[full]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _may_match(chunk: K.Chunk, data: bytes) -> np.ndarray:
    """Texts that hold a keyword of ASSIGN, the head of ACCESS or enough hexadecimal digits in a row; no other can match."""
    out = np.zeros(len(chunk), bool)
    run = np.cumsum(np.concatenate([[0], _HEX[chunk.buf]]), dtype=np.int32)
    places = [_places(K.LOWER[chunk.buf].tobytes(), _ASSIGNED), _places(data, (b"AKIA",)), np.flatnonzero(run[16:] - run[:-16] == 16)]
    out[np.searchsorted(chunk.off, np.concatenate(places), "right") - 1] = True
    return out


def scan_chunk(chunk: K.Chunk, model: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[bytes, list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Bytes, base spans and all spans of each text; places in code points."""
    owner, a, b = field_spans(chunk, *model)
    at = np.searchsorted(owner, np.arange(len(chunk) + 1))
    data = chunk.buf.tobytes()
    may = _may_match(chunk, data)
    for i in range(len(chunk)):
        lo = int(chunk.off[i])
        raw = data[lo : lo + int(chunk.size[i])]
        base = base_spans(raw.decode("utf-8")) if may[i] else []
        found = list(base)
        for j in range(at[i], at[i + 1]):
            s = len(raw[: a[j] - lo].decode("utf-8"))
            e = s + len(data[a[j] : b[j]].decode("utf-8"))
            if not any(x < e and s < y for x, _, y in base):
                found.append((s, 3, e))
        yield raw, base, sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    model = trained()
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                rows = []
                for _, base, found in scan_chunk(chunk, model):
                    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                    rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), *columns], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every secret replaced by mask, in the same columns; n_chars follows the text, null texts stay null."""
    model, names = trained(), docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(place)):
                part = batch.slice(chunk.first, len(chunk))
                there = part.column(place).is_valid().to_pylist()
                texts = [(_masked(t.decode("utf-8"), found, mask) if found else t.decode("utf-8")) if ok else None for (t, _, found), ok in zip(scan_chunk(chunk, model), there, strict=True)]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    out = map_batches(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
