"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate around them."""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | {"-"}
PHONE = DIGITS | frozenset(" ().-")
WORDY = LETTERS | DIGITS | {"_"}
#: Kinds in the order in which spans are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url_login", "iban", "ssn", "account", "address", "secret")
#: The length of an IBAN by its country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
#: Cues of account numbers and of postal addresses, in lower case.
ACCOUNT_CUES = ("account number", "account no", "account #", "acct no", "acct #", "kontonummer", "numéro de compte", "número de cuenta", "passport number", "passport no", "routing number")
#: Cues of secrets, in lower case: a value of 16 or more characters of SECRET, a digit among them, follows a sign of assignment.
SECRET_CUES = ("token", "secret", "passwd", "password", "api_key", "api key", "apikey", "access_key", "private_key", "auth_key")
SECRET, SECRET_CHARS = LETTERS | DIGITS | frozenset("_-./+="), 16
STREETS = ("street", "avenue", "boulevard", "road", "lane", "drive", "straße", "strasse")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    for cue, kind in (("@", "at"), ("://", "scheme"), ("+", "plus")):
        found.add_word(cue, (kind, len(cue)))
    for cue in ACCOUNT_CUES:
        found.add_word(cue, ("account", len(cue)))
    for cue in SECRET_CUES:
        found.add_word(cue, ("secret", len(cue)))
    for cue in STREETS:
        found.add_word(cue, ("street", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _run(text: str, at: int, of: frozenset) -> int:
    """The end of the run of characters of `of` from `at`."""
    n = len(text)
    while at < n and text[at] in of:
        at += 1
    return at


def _back(text: str, at: int, of: frozenset, least: int) -> int:
    """The start of the run of characters of `of` before `at`, not before `least`."""
    while at > least and text[at - 1] in of:
        at -= 1
    return at


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`: a local part to its left, two or more labels to its right."""
    start = _back(text, at, LOCAL, least)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = after, dots + 1
    return (start, end) if dots else None


def _ips(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], int]:
    """The addresses in the chain of dotted numbers that begins with the digits [start, end), and the chain's end."""
    parts = [(start, end)]
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        start, end = end + 1, _run(text, end + 1, DIGITS)
        parts.append((start, end))
    fours = [parts[i : i + 4] for i in range(0, len(parts) - 3, 4)]
    small = lambda a, b: len(x := text[a:b].lstrip("0")) < 4 and int(x or 0) <= 255
    return [(four[0][0], four[3][1]) for four in fours if all(small(*p) for p in four)], end


def _card(text: str, end: int) -> int:
    """The end of the run of digits, each with at most one space or hyphen before it, whose first digits end at `end`."""
    while end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
        end = _run(text, end + 1, DIGITS)
    return end


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """The number after the plus at `at`: a digit, one or more of PHONE, a digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 and text[end - 1] in DIGITS else None


def _iban(text: str, start: int, end: int) -> tuple[int, int] | None:
    """An IBAN whose two check digits are [start, end): country before them, groups after them, length and remainder right."""
    if end - start < 2 or start < 2 or text[start - 2 : start] not in IBAN_LENGTHS or (start > 2 and text[start - 3] in WORDY):
        return None
    at, kept = start - 2, ""
    need = IBAN_LENGTHS[text[at : at + 2]]
    while at < len(text) and len(kept) < need:
        c = text[at]
        if c in DIGITS or "A" <= c <= "Z":
            kept += c
        elif not (c == " " and len(kept) % 4 == 0):
            return None
        at += 1
    if len(kept) < need or (at < len(text) and text[at] in WORDY):
        return None
    moved = kept[4:] + kept[:4]
    return (start - 2, at) if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else None


def _ssn(text: str, start: int, end: int) -> tuple[int, int] | None:
    """ddd-dd-dddd with no digit or hyphen next to it, outside the blocks that are never issued."""
    if end - start != 3 or (start and (text[start - 1] in WORDY or text[start - 1] == "-")) or text[start] == "9" or text[start:end] in ("000", "666"):
        return None
    s = text[start : start + 11]
    good = len(s) == 11 and s[3] == s[6] == "-" and all(c in DIGITS for c in s[4:6] + s[7:]) and s[4:6] != "00" and s[7:] != "0000"
    after = text[start + 11 : start + 12]
    return (start, start + 11) if good and not (after and (after in WORDY or after == "-")) else None


def find(text: str | None, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans (start, end in code points) of each kind, in order and without overlaps within a kind.

    Base kinds follow leftmost non-overlapping matching of their patterns; a match that fails its test is dropped and
    its characters aren't tried again for that kind.
    """
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    if not text:
        return spans
    folded = text.lower()
    if len(folded) != len(text):  # a few letters change their length; these stay as written, so that places don't move
        folded = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    done = dict.fromkeys(("digits", "email", "card", "ip", "phone", *ADDED), 0)
    for last, (kind, width) in automaton.iter(folded):
        at = last + 1 - width
        if kind == "digit":
            if at < done["digits"]:
                continue
            end = _run(text, at, DIGITS)
            done["digits"] = end
            if at >= done["ip"]:
                found, done["ip"] = _ips(text, at, end)
                spans["ip"] += found
            if at >= done["card"]:
                stop = _card(text, end)
                done["card"] = stop
                if stop - at >= 13 and 13 <= len(digits := "".join(c for c in text[at:stop] if c in DIGITS)) <= 19 and luhn(digits):
                    spans["card"].append((at, stop))
            if (got := _iban(text, at, end)) and got[0] >= done["iban"]:
                spans["iban"].append(got)
                done["iban"] = got[1]
            if got := _ssn(text, at, end):
                spans["ssn"].append(got)
        elif kind == "at":
            if got := _email(text, at, done["email"]):
                spans["email"].append(got)
                done["email"] = got[1]
        elif kind == "plus":
            if at >= done["phone"] and (got := _phone(text, at)):
                done["phone"] = got[1]
                if 9 <= sum(c in DIGITS for c in text[at : got[1]]) <= 15:
                    spans["phone"].append(got)
        elif kind == "scheme":
            # user:secret@host right after the scheme
            start, stop = _back(text, at, LETTERS, done["url_login"]), at + 3
            while stop < len(text) and text[stop] not in " \t\r\n\v\f/@<>\"'":
                stop += 1
            if start < at and stop < len(text) and text[stop] == "@" and ":" in text[at + 3 : stop] and (end := _run(text, stop + 1, LABEL | {"."})) > stop + 1:
                spans["url_login"].append((start, end))
                done["url_login"] = end
        elif kind == "account":
            start = at + width
            while start < len(text) and start < at + width + 4 and text[start] in " :.#":
                start += 1
            end = _run(text, start, DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ -"))
            while end > start and text[end - 1] not in DIGITS:
                end -= 1
            if start >= done["account"] and 6 <= sum(c in DIGITS for c in text[start:end]) <= 20:
                spans["account"].append((start, end))
                done["account"] = end
        elif kind == "secret":
            if got := _secret(text, at + width, done["secret"]):
                spans["secret"].append(got)
                done["secret"] = got[1]
        elif kind == "street":
            if got := _address(text, at, at + width, done["address"]):
                spans["address"].append(got)
                done["address"] = got[1]
    return spans


def _secret(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The value that is assigned to the name which ends with the cue before `at`."""
    at = _run(text, at, WORDY | {"-"})  # token_2, SECRET-KEY
    at = _run(text, at, frozenset("\"' "))
    if at >= len(text) or text[at] not in ":=":
        return None
    start = _run(text, _run(text, at, frozenset(":=>")), frozenset("\"' "))
    end = _run(text, start, SECRET)
    while end > start and text[end - 1] in "./=":  # the end of a sentence isn't part of it
        end -= 1
    good = start >= least and end - start >= SECRET_CHARS and any(c in DIGITS for c in text[start:end])
    return (start, end) if good else None


def _address(text: str, at: int, end: int, least: int) -> tuple[int, int] | None:
    """A house number and one to three capitalised words before a street's kind, in one line."""
    if end < len(text) and text[end] in WORDY:
        return None
    start, words = at, 0
    while words < 4 and start > least and text[start - 1] == " ":
        stop = start - 1
        start = stop
        while start > least and text[start - 1] not in " \t\n\r\v\f":
            start -= 1
        word = text[start:stop]
        if words and word.isascii() and word.isdigit() and len(word) <= 5:
            return start, end
        if not word[:1].isupper():
            return None
        words += 1
    return None


def listed(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans[k]))


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, found in spans.items() for a, b in found):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def _find(redacted: bool):
    def run(batches):
        automaton = _automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    spans = find(text, automaton)
                    sha = hashlib.sha256(listed(spans, BASE).encode()).hexdigest()
                    rows.append((doc_id, *(len(spans[k]) for k in BASE), sha, listed(spans, (*BASE, *ADDED)), redact(text, spans) if redacted else None))
                kinds = [pa.int64()] * 5 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return run


def personal_data(docs: DataFrame, *, redacted: bool = True) -> DataFrame:
    """One row for each row of `docs`: doc_id, counts of the base kinds, base_sha256, spans, redacted (the text, spans replaced).

    Spans are kind:start:end in code points, end exclusive, by kind and start. Base kinds are email, ip, card and phone;
    added are logins in URLs, IBANs, social security numbers, account numbers after a cue, street addresses, and secrets
    that are assigned to a name like token or password; they may overlap base spans. A null text counts as empty: no spans (its redacted text is null). Repeated rows give equal
    rows; ties can't arise. Long texts are passed over once, from cue to cue. An empty table gives no rows. Other columns aren't read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_find(redacted), SCHEMA)
