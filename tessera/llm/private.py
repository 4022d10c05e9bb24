"""Personal data: fixed patterns, and a skip-chain conditional random field over tokens for what they miss.

The patterns of the contract (email, ip, card, phone) give the base spans. The field labels tokens: every token that holds a
digit or an at sign, and the words of addresses that are spelt out, is a node with a label for the beginning or the inside of a
kind, or for none. Its features are the token's form and the words around it, no pattern of an entity. Chain edges join
neighbours. Distant repeated or similar tokens share one hidden node, whose potentials favour one kind for all of them.
Messages pass along the chains exactly and between chains and hidden nodes round after round, until they settle. Tokens of
base spans are observed. The weights are trained here by pseudo-likelihood on generated, labelled sequences of bounded number.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import map_texts, read

#: Kinds of the contract, and those that the field finds besides.
KINDS = ("email", "ip", "card", "phone", "identity", "secret")
BASE_KINDS = 4
#: Labels of a token: none, or the beginning or the inside of a kind.
LABELS = ("none", *(f"{part}-{kind}" for kind in KINDS for part in ("b", "i")))
#: Kind of each label, 0 for none, and the labels inside an entity.
LABEL_KIND = np.array([0, *(k + 1 for k in range(len(KINDS)) for _ in range(2))])
INSIDE = np.array([label.startswith("i-") for label in LABELS])
#: Marginal probability from which a token belongs to a kind.
SURE = 0.7
#: Nodes at most so many characters apart are neighbours of the chain; tokens at most so many apart may be one entity.
NEAR, TOUCHING = 80, 4
#: Rounds between chains and hidden nodes end when no message changes by more, or after so many rounds where loops never settle.
SETTLED, ROUNDS, DAMPING = 1e-4, 50, 0.3
#: Generated training sequences, steps and rate.
SEQUENCES, STEPS, RATE, DECAY = 900, 500, 0.5, 3e-4

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

TOKEN = re.compile(r"\+?\(?\w(?:[\w.%+@/-]*\w)?\)?")
SPELT = re.compile(r"(?i)[\[(]\s*(?:at|dot|punkt)\s*[\])]|\bat\b[^.\n]{1,40}\bdot\b")
LINKS = {"at": "at", "dot": "dot", "punkt": "dot"}
#: Words before a node that speak for a kind, or against all.
CUES = {
    "email": "email mail e-mail contact write reach courriel correo kontakt",
    "ip": "ip address host server from ipv4 login gateway dns adresse",
    "card": "card visa mastercard amex credit debit payment charge charged karte kreditkarte carte tarjeta",
    "phone": "tel phone call mobile fax cell telephone ring dial telefon handy rufnummer teléfono téléphone portable mobil",
    "identity": "ssn social security passport iban account konto passport reisepass tax steuer license licence dni nif bank",
    "secret": "token key secret password passwort pwd apikey api_key access auth bearer credential contraseña passwd",
    "none": "version v isbn order invoice serial item build section part release sku page chapter figure table room year in since until about euro dollars eur usd percent model article bestellung seite kapitel uhr line step version-no port",
}
CUE_OF = {w: f"cue_{kind}" for kind, words in CUES.items() for w in words.split()}
SHAPES = (
    ("octets", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")), ("version", re.compile(r"v?[0-9]+(?:\.[0-9]+){1,2}")), ("date", re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")),
    ("three_two_four", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")), ("three_four", re.compile(r"[0-9]{3}[-.][0-9]{4}")), ("three_three_four", re.compile(r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}")),
    ("fours", re.compile(r"[0-9]{4}(?:-[0-9]{4}){3}")), ("mail", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*")), ("iban", re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}")),
    ("country_check", re.compile(r"[A-Z]{2}[0-9]{2}")), ("plus", re.compile(r"\+.*")), ("brackets", re.compile(r"\(.*\)")), ("digits", re.compile(r"[0-9]+")), ("ordinal", re.compile(r"[0-9]+(?:st|nd|rd|th|er|e|m|km|kg|gb|mb|px|x)")),
    ("hyphened", re.compile(r"[0-9]+(?:-[0-9]+)+")), ("slashed", re.compile(r"[0-9]+(?:/[0-9]+)+")),
)
FEATURES = (
    "one", *(name for name, _ in SHAPES), *(f"digits_{k}" for k in (0, 1, 2, 3, 4, 5, 7, 8, 10, 12, 13, 16, 17)), "luhn", "card_start", "leading_zero", "year", "long", "mixed", "many_switches", "hex", "upper_mixed", "glued", "quoted", "assigned",
    *(f"cue_{kind}" for kind in CUES), *(f"far_cue_{kind}" for kind in CUES), "is_at", "is_dot", "before_at", "after_at", "before_dot", "after_dot", "word", "left_touches", "right_touches", "left_digits", "right_digits", "few_left_run", "run_10", "run_16", "run_20",
)
FEATURE = {name: i for i, name in enumerate(FEATURES)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the contract's patterns, in order of kind and start. Linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Nodes:
    """The tokens of a text that are labelled: their spans, features, keys, and which touch the one before."""

    def __init__(self, text: str):
        spelt = bool(SPELT.search(text))
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)] if spelt or "@" in text or DIGIT.search(text) else []
        words = [text[s:e] for s, e in tokens]
        chosen = [i for i, w in enumerate(words) if "@" in w or DIGIT.search(w)]
        if spelt:
            around = {j for i, w in enumerate(words) if w.strip("()").lower() in LINKS for j in (i - 1, i, i + 1) if 0 <= j < len(words)}
            chosen = sorted(around | set(chosen))
        self.text, self.spans = text, [self._trimmed(words[i], *tokens[i]) for i in chosen]
        self.touches = np.zeros(len(chosen), bool)
        for k in range(1, len(chosen)):
            self.touches[k] = chosen[k] == chosen[k - 1] + 1 and tokens[chosen[k]][0] - tokens[chosen[k - 1]][1] <= TOUCHING and "\n" not in text[tokens[chosen[k - 1]][1] : tokens[chosen[k]][0]]
        self.chain = np.array([k > 0 and self.spans[k][0] - self.spans[k - 1][1] <= NEAR for k in range(len(chosen))], bool)
        self.keys = [self._key(words[i]) for i in chosen]
        runs = self._runs([words[i] for i in chosen])
        self.features = np.zeros((len(chosen), len(FEATURES)))
        for k, i in enumerate(chosen):
            for name in self._named(words, tokens, i, k, runs):
                self.features[k, FEATURE[name]] = 1

    @staticmethod
    def _trimmed(word: str, start: int, end: int) -> tuple[int, int]:
        """A token without a bracket that has no partner in it."""
        if word.endswith(")") and "(" not in word:
            end -= 1
        if word.startswith("(") and ")" not in word:
            start += 1
        return start, end

    @staticmethod
    def _key(word: str) -> str | None:
        """What similar tokens share: the last seven digits of a number, or else the token in small letters. Short ones share nothing."""
        digits = "".join(DIGIT.findall(word))
        if len(digits) >= 7 and sum(map(str.isalpha, word)) <= 2:
            return digits[-7:]
        return word.lower() if len(word) >= 6 else None

    def _runs(self, words: list[str]) -> list[int]:
        """Digits of the nodes that touch each other, for each of them. A token that is a whole number by itself stands alone, and a
        plus sign begins anew."""
        digits = [sum(map(str.isdigit, w)) for w in words]
        whole = [n >= 12 or "@" in w or w.count(".") == 3 for n, w in zip(digits, words, strict=True)]
        out, start = [0] * len(words), 0
        for k in range(1, len(words) + 1):
            if k == len(words) or not self.touches[k] or whole[k] or whole[k - 1] or words[k].startswith("+"):
                out[start:k] = [sum(digits[start:k])] * (k - start)
                start = k
        return out

    def _named(self, words: list[str], tokens: list[tuple[int, int]], i: int, k: int, runs: list[int]) -> list[str]:
        word, low = words[i], words[i].lower()
        plain = word.strip("()")
        digits = "".join(DIGIT.findall(word))
        out = ["one", *(name for name, shape in SHAPES if shape.fullmatch(word))]
        out.append("digits_" + str(max(n for n in (0, 1, 2, 3, 4, 5, 7, 8, 10, 12, 13, 16, 17) if n <= len(digits))))
        letters = [c for c in plain if c.isalpha()]
        switches = sum(a.isdigit() != b.isdigit() for a, b in zip(plain, plain[1:]))
        tests = {
            "luhn": 13 <= len(digits) <= 19 and luhn(digits), "card_start": len(digits) >= 4 and digits[0] in "3456", "leading_zero": digits.startswith("0"), "year": len(digits) == 4 and digits[:2] in ("18", "19", "20") and plain.isdigit(),
            "long": len(plain) >= 20, "mixed": bool(letters) and bool(digits) and len(plain) >= 12 and "@" not in plain and "/" not in plain, "many_switches": switches >= 5, "hex": len(plain) >= 24 and bool(HEX.fullmatch(plain)),
            "upper_mixed": len(plain) >= 16 and plain.isupper() and bool(digits) and plain.isalnum(), "word": not digits and "@" not in word, "is_at": LINKS.get(plain.lower()) == "at", "is_dot": LINKS.get(plain.lower()) == "dot",
            "left_touches": bool(self.touches[k]), "right_touches": k + 1 < len(self.touches) and bool(self.touches[k + 1]), "run_10": 9 <= runs[k] <= 15, "run_16": 13 <= runs[k] <= 19, "run_20": runs[k] >= 20, "few_left_run": runs[k] < 7,
        }
        out += [name for name, there in tests.items() if there]
        before = self.text[max(0, tokens[i][0] - 2) : tokens[i][0]]
        if before[-1:] and not before[-1].isspace():
            out.append("quoted" if before[-1] in "\"'" else "assigned" if before[-1] in "=:" else "glued")
        if re.search(r"[=:]\s?[\"']?$", self.text[max(0, tokens[i][0] - 4) : tokens[i][0]]):
            out.append("assigned")
        for name, j in (("before_at", i + 1), ("after_at", i - 1), ("before_dot", i + 1), ("after_dot", i - 1)):
            if 0 <= j < len(words) and LINKS.get(words[j].strip("()").lower()) == name.split("_")[1]:
                out.append(name)
        for back, prefix in ((1, ""), (2, "far_"), (3, "far_")):
            cue = CUE_OF.get(words[i - back].lower().strip("()")) if i >= back else None
            if cue:
                out.append(prefix + cue)
        if i and DIGIT.search(words[i - 1]):
            out.append("left_digits")
        if i + 1 < len(words) and DIGIT.search(words[i + 1]):
            out.append("right_digits")
        return out


HEX = re.compile(r"[0-9a-fA-F]+")


class Field:
    """Weights: unary (labels x features), chain between tokens that touch and between those that are only near (labels x labels), and
    how much a token and the hidden node of its key should be of one kind."""

    def __init__(self, unary: np.ndarray, touch: np.ndarray, near: np.ndarray, same: float):
        self.unary, self.touch, self.near, self.same = unary, touch, near, same

    def potentials(self, nodes: Nodes) -> np.ndarray:
        out = nodes.features @ self.unary.T
        out[np.ix_(~nodes.touches, INSIDE)] = -np.inf
        return out

    def marginals(self, theta: np.ndarray, nodes: Nodes) -> np.ndarray:
        """Sum-product messages in logarithms: forwards and backwards along the chains, which is exact, and between tokens and the hidden
        nodes of their keys until these messages settle."""
        groups: dict[str, list[int]] = {}
        for k, key in enumerate(nodes.keys):
            if key is not None:
                groups.setdefault(key, []).append(k)
        hubs = [g for g in groups.values() if len(g) > 1]
        member = np.array([k for g in hubs for k in g], np.int64)
        hub = np.array([n for n, g in enumerate(hubs) for _ in g], np.int64)
        kinds = len(KINDS) + 1
        agree = np.where(LABEL_KIND[:, None] == np.arange(kinds)[None], self.same, 0.0)
        down = np.zeros((len(member), len(LABELS)))  # from hidden nodes to tokens
        steps = self._steps(nodes)
        for _ in range(ROUNDS):
            local = theta.copy()
            local[member] += down
            belief = self._chains(local, nodes, steps)
            if not len(member):
                break
            # what a token says to its hidden node, and what that says back, without what it heard from it
            up = np.logaddexp.reduce((belief[member] - down)[:, :, None] + agree[None], axis=1)
            up -= up.max(axis=1, keepdims=True)
            total = np.zeros((len(hubs), kinds))
            np.add.at(total, hub, up)
            new = np.logaddexp.reduce((total[hub] - up)[:, None, :] + agree[None], axis=2)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            change = np.abs(new - down).max()
            down = DAMPING * down + (1 - DAMPING) * new
            if change <= SETTLED:
                break
        belief = belief - belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True)

    @staticmethod
    def _steps(nodes: Nodes) -> list[np.ndarray]:
        """Nodes by their place in their chain: chains are walked side by side."""
        place = np.zeros(len(nodes.chain), np.int64)
        for k in np.flatnonzero(nodes.chain).tolist():
            place[k] = place[k - 1] + 1
        order = np.argsort(place, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []

    def _chains(self, local: np.ndarray, nodes: Nodes, steps: list[np.ndarray]) -> np.ndarray:
        forward, backward = np.zeros_like(local), np.zeros_like(local)
        pair = np.where(nodes.touches[:, None, None], self.touch[None], self.near[None]) if len(local) < 1 << 12 else None

        def link(k: np.ndarray) -> np.ndarray:
            return pair[k] if pair is not None else np.where(nodes.touches[k][:, None, None], self.touch[None], self.near[None])

        def scaled(m: np.ndarray) -> np.ndarray:
            return m - np.logaddexp.reduce(m, axis=1, keepdims=True)

        for k in steps[1:]:
            forward[k] = scaled(np.logaddexp.reduce((local[k - 1] + forward[k - 1])[:, :, None] + link(k), axis=1))
        for k in reversed(steps[1:]):
            backward[k - 1] = scaled(np.logaddexp.reduce((local[k] + backward[k])[:, None, :] + link(k), axis=2))
        return local + forward + backward


def generated(seed: int = 11, count: int = SEQUENCES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts: (text, [(start, end, kind number)]). Entities in several spellings, repeated now and then, and numbers that look
    alike but are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    pick = rng.choice
    syllables = "an ber con del est for ge hin ing ka lo mar nen or pa qui ra sen ti un ver wo za el da su".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    upper = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=k))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    case = {kind: [w for w in words.split() if w not in ("in", "v")] for kind, words in CUES.items()}

    def card() -> str:
        head = pick("3456") + digits(14)
        whole = head + next(c for c in "0123456789" if luhn(head + c))
        whole = whole if rng.random() < 0.7 else digits(16)  # a digit may be wrong, or the number that of another scheme
        return pick((whole, " ".join(whole[i : i + 4] for i in range(0, 16, 4)), "-".join(whole[i : i + 4] for i in range(0, 16, 4))))

    def phone() -> str:
        p = digits(10)
        return pick((
            f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}", f"({p[:3]}) {p[3:6]}-{p[6:]}", f"{p[:3]}-{p[3:6]}-{p[6:]}", f"{p[:3]}.{p[3:6]}.{p[6:]}", f"+1-{p[:3]}-{p[3:6]}-{p[6:]}", f"0{p[:3]} {digits(8)}", f"0{p[:2]} {digits(7)}", f"0{p[:3]}/{digits(7)}",
            f"0{p[0]} {p[1:3]} {p[3:5]} {p[5:7]} {p[7:9]}", f"+{p[:2]} {p[2:5]} {digits(7)}", f"00{p[:2]} {p[2:5]} {digits(7)}", f"{p[:3]} {p[3:6]} {p[6:]}", f"0{p[:3]}-{digits(6)}",
        ))

    def mail() -> str:
        at, dot = pick(((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("@", ".")))
        name, host = word() + pick(("", ".", "_", digits(2))) + word(), word()
        return f"{name}{at}{host}" if at == "@" else f"{name}{at}{host}{dot}{pick(('com', 'org', 'de', 'net'))}"

    def identity() -> str:
        body = digits(18)
        return pick((
            f"{digits(3)}-{digits(2)}-{digits(4)}", "DE" + digits(20), "DE" + digits(2) + " " + " ".join(body[i : i + 4] for i in range(0, 18, 4)), "GB" + digits(2) + upper(4) + digits(14), "FR" + digits(25), f"{digits(8)}{pick('ABCDEFGH')}",
        ))

    def secret() -> str:
        return pick((lambda: hexes(pick((32, 40, 64))), lambda: "AKIA" + upper(16), lambda: "sk_live_" + hexes(24), lambda: "ghp_" + "".join(rng.choices("abcdefABCDEF0123456789xyzXYZ", k=36)), lambda: hexes(40).upper()))()

    makers = {"email": mail, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone, "identity": identity, "secret": secret}
    needs_cue = lambda kind, body: kind == "identity" and body[-1].isalpha() or kind == "phone" and re.fullmatch(r"\d{3} \d{3} \d{4}|0\d+ \d+|0\d+-\d+", body) and rng.random() < 0.5

    def lookalike() -> str:
        return pick((
            lambda: f"{pick(('order', 'invoice', 'serial', 'sku', 'item'))} {digits(pick((6, 8, 10, 12, 16)))}", lambda: f"isbn 978{digits(10)}", lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 400)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            lambda: f"serial {digits(4)} {digits(4)} {digits(4)}", lambda: f"item {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"look at {word()}.com", lambda: f"id={digits(pick((8, 15)))}",
            lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.1.2", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
            lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1900, 2030)}", lambda: f"in {rng.randint(1900, 2030)}", lambda: str(rng.randint(0, 99)), lambda: f"{rng.randint(1, 999)},{digits(3)}", lambda: f"{rng.randint(1, 999)}.{digits(2)} euro",
            lambda: f"{rng.randint(0, 23)}:{rng.randint(10, 59)}", lambda: f"pages {digits(2)}-{digits(3)}", lambda: f"{digits(2)} {digits(2)} {digits(2)}", lambda: f"{digits(1)}{pick(('st', 'th', 'km', 'kg', 'gb', 'x'))}", lambda: f"room {digits(3)} at {word()}",
            lambda: digits(pick((5, 6, 7, 8))), lambda: f"{rng.randint(1, 99)} %", lambda: f"#{hexes(6)}", lambda: f"{word()}{digits(2)}", lambda: f"section {digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(3)} {digits(3)} {digits(3)} euro", lambda: f"{word()} at {word()} and {word()}",
            lambda: f"https/{word()}/{digits(4)}/{digits(2)}", lambda: f"model {pick('ABX')}{digits(4)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{rng.randint(1, 20)} of {rng.randint(20, 99)}",
            lambda: f"{word()} at the dot com {word()}", lambda: f"{word()} at {pick(('the', 'a', 'this'))} {word()}, dot {word()}",
        ))()

    out = []
    for _ in range(count):
        text, truth, seen = "", [], []
        for _ in range(rng.randint(1, 7)):
            if not text.endswith(tuple("0123456789 ")) or rng.random() < 0.88:  # now and then two numbers stand side by side
                text += " ".join(word() for _ in range(rng.randint(1, 9))) + pick((" ", " ", ". ", ", ", "\n"))
            if seen and rng.random() < 0.3:
                body, kind = pick(seen)
                if kind == "phone" and rng.random() < 0.5 and re.search(r"\d{3}-\d{4}$", body):
                    body = body[-8:]  # the number without its prefix: only the distant whole one tells
            elif rng.random() < 0.6:
                kind = pick(list(makers))
                body = makers[kind]()
                seen.append((body, kind))
                if rng.random() < 0.35 or needs_cue(kind, body):
                    text += pick(case[kind]) + pick((" ", ": ", " = ", " is "))
            else:
                text += lookalike() + pick((" ", ". ", ", "))
                continue
            quote = pick(("", "", "", '"'))
            text += quote
            truth.append((len(text), len(text) + len(body), KINDS.index(kind)))
            text += body + quote + pick((" ", ". ", ", ", "!! ", "### ", " "))
        out.append((text, truth))
    return out


def labelled(nodes: Nodes, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels of the nodes that lie in spans (start, end, kind), in order; -1 for the others."""
    out, at = np.full(len(nodes.spans), -1), 0
    for start, end, kind in spans:
        while at < len(nodes.spans) and nodes.spans[at][1] <= start:
            at += 1
        first, k = True, at
        while k < len(nodes.spans) and nodes.spans[k][0] < end:
            out[k] = 1 + 2 * kind + (0 if first or not nodes.touches[k] else 1)
            first, k = False, k + 1
    return out


@functools.cache
def trained(seed: int = 11) -> Field:
    """Maximum pseudo-likelihood by gradient ascent: every node's label given its features and its neighbours' labels."""
    made = [(Nodes(text), truth) for text, truth in generated(seed)]
    made = [(n, t) for n, t in made if len(n.spans)]
    x = np.concatenate([n.features for n, _ in made])
    y = np.concatenate([np.maximum(labelled(n, t), 0) for n, t in made])
    touches, chain = (np.concatenate([getattr(n, name) for n, _ in made]) for name in ("touches", "chain"))
    pairs, start = [], 0
    for n, _ in made:
        last: dict[str, int] = {}
        for k, key in enumerate(n.keys):
            if key is not None:
                if key in last:
                    pairs.append((start + last[key], start + k))
                last[key] = k
        start += len(n.spans)
    left, right = np.array(pairs, np.int64).reshape(-1, 2).T
    size, kinds = len(LABELS), len(KINDS) + 1
    field = Field(np.zeros((size, x.shape[1])), np.zeros((size, size)), np.zeros((size, size)), 0.0)
    gold, gold_kind = np.eye(size)[y], np.eye(kinds)[LABEL_KIND[y]]
    of_kind = np.eye(kinds)[LABEL_KIND]  # labels x kinds
    tight, loose = np.flatnonzero(touches), np.flatnonzero(chain & ~touches)
    n = len(y)
    for _ in range(STEPS):
        score = x @ field.unary.T
        for k, weights in ((tight, field.touch), (loose, field.near)):
            np.add.at(score, k, weights[y[k - 1]])
            np.add.at(score, k - 1, weights[:, y[k]].T)
        np.add.at(score, left, field.same * gold_kind[right] @ of_kind.T)
        np.add.at(score, right, field.same * gold_kind[left] @ of_kind.T)
        score[np.ix_(~touches, INSIDE)] = -np.inf
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = gold - p
        field.unary += RATE * (20 * gap.T @ x / n - DECAY * field.unary)
        for k, weights in ((tight, field.touch), (loose, field.near)):
            grow = np.zeros_like(weights)
            np.add.at(grow, y[k - 1], gap[k])
            np.add.at(grow.T, y[k], gap[k - 1])
            weights += RATE * (20 * grow / n - DECAY * weights)
        agree = (gap[left] @ of_kind * gold_kind[right]).sum() + (gap[right] @ of_kind * gold_kind[left]).sum()
        field.same += RATE * (20 * agree / n - DECAY * field.same)
    return field


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (kind number, start, end) in order of kind and start."""
    base = base_spans(text)
    nodes = Nodes(text)
    if not len(nodes.spans):
        return base, base
    held = sorted((s, e, k) for k, s, e in base)
    known = labelled(nodes, held)
    if (known >= 0).all():
        return base, base
    theta = field.potentials(nodes)
    seen = np.flatnonzero(known >= 0)
    theta[seen] = -np.inf
    theta[seen, known[seen]] = 0
    p = field.marginals(theta, nodes)
    kind_of = p @ np.eye(len(KINDS) + 1)[LABEL_KIND]
    best, kind = p.argmax(axis=1), kind_of.argmax(axis=1)
    added: list[tuple[int, int, int]] = []
    sure: list[float] = []
    for k in np.flatnonzero((known < 0) & (kind > 0)).tolist():
        start, end = nodes.spans[k]
        goes_on = added and k and known[k - 1] < 0 and nodes.touches[k] and INSIDE[best[k]] and kind[k - 1] == kind[k] and added[-1][2] == nodes.spans[k - 1][1]
        if goes_on:
            added[-1] = (added[-1][0], added[-1][1], end)
            sure[-1] = min(sure[-1], kind_of[k, kind[k]])
        else:
            added.append((int(kind[k]) - 1, start, end))
            sure.append(kind_of[k, kind[k]])
    return base, sorted(base + [a for a, q in zip(added, sure, strict=True) if q >= SURE])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by <KIND>; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, column: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, if asked for, clean (the redacted text).

    Counts and digest are of the base spans; ``spans`` has the field's too. Null and empty texts have none. Equal rows
    are kept. Every document is judged whole and on its own in an Arrow batch; nothing is shuffled. The field's weights
    (a few hundred numbers) are trained on the driver and sent with the function.
    """
    field = trained()

    def make(texts: list[str]) -> list[list]:
        found = [find(t, field) for t in texts]
        counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(BASE_KINDS)]
        digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
        clean = [[redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]] if with_text else []
        return [*counts, digest, [joined(spans) for _, spans in found], *clean]

    fields = {f"n_{k}": pa.int64() for k in KINDS[:BASE_KINDS]} | {"base_sha256": pa.string(), "spans": pa.string()}
    return map_texts(docs, column, fields | ({"clean": pa.string()} if with_text else {}), make)


def scrubbed(docs: DataFrame) -> DataFrame:
    """``docs`` with the found spans of ``text`` replaced by their kind, and n_chars, where there is one, counted anew.

    Null texts stay null; the other columns and the number of rows are as before.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    field, schema = trained(), to_arrow_schema(docs.schema)
    text, count = schema.get_field_index("text"), schema.get_field_index("n_chars")

    def run(batches):
        for batch in batches:
            clean = [None if t is None else redacted(t, find(t, field)[1]) for t in batch.column(text).to_pylist()]
            columns = list(batch.columns)
            columns[text] = pa.array(clean, schema.field(text).type)
            if count >= 0:
                columns[count] = pa.array([None if t is None else len(t) for t in clean], schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))


QUERIES = {"op5_personal_data": query}
ORACLE_SQL: dict[str, str] = {}
