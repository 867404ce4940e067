"""Tokenizers and normalizers as Column -> Column functions; a normalizer returns null for a token that it drops."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_
from pathlib import Path

from pyspark.sql import Column, functions as F

Tokenizer = Callable[[Column], Column]

# The English and Spanish stop words.
ENGLISH = """
a about above after again against all am an and any are as at be because been before being below between both but by can
did do does doing down during each few for from further had has have having he her here hers herself him himself his how
i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves
out over own same she should so some such than that the their theirs them themselves then there these they this those
through to too under until up very was we were what when where which while who whom why with you your yours yourself
yourselves
""".split()
SPANISH = """
a acá ahí al algo algunas algunos allá allí ambos ante antes aquel aquella aquellas aquello aquellos aquí arriba así
aunque bajo bien cada casi como con contra cual cuales cualquier cualquiera cuando de del demás dentro desde donde dos el
él ella ellas ellos en encima entonces entre era erais éramos eran eras eres es esa esas ese eso esos esta estaba
estaban estado estáis estamos están estar estas este esto estos estoy fin fue fueron fui fuimos ha habéis había habían haber
habrá habrán hace hacen hacer hacia han hasta hay incluso intenta intentas intentamos intentan intentar ir la las le les
lo los más me menos mi mis mientras mío míos misma mismas mismo mismos mucho muchos muy nada ni no nos nosotras nosotros
nuestra nuestras nuestro nuestros nunca o os otra otras otro otros para pero poco por porque que qué quien quienes se sea
sean ser si sí siendo sin sobre sois solamente solo somos soy su sus tal también tampoco tan tanto te tendrá tendrán tengo
ti tiene tienen todo todos tu tus tú un una unas uno unos usted ustedes va vais vamos van varios vaya verdad vosotras
vosotros voy y ya
""".split()
#: The word lists by the file names under which they may be asked for.
BUNDLED = {"stopwords_en.txt": ENGLISH, "stopwords_es.txt": SPANISH}

EDGES = "^[^a-z0-9]+|[^a-z0-9]+$"
#: A token without its edges: from the first a-z or 0-9 to the last one before white space. Each character is looked at
#: twice at most, however long a run is.
TRIMMED = r"[a-z0-9](?:\S*[a-z0-9])?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once: in a lambda, an expression that is written twice is evaluated twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _listed(tokens: Column) -> Column:
    return F.coalesce(tokens, F.array().cast("array<string>"))


def whitespace_tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space; null or blank: no tokens. Tokens of nothing but Unicode white space are no tokens."""
    odd = text.rlike(r"[\p{javaWhitespace}&&[^\s]]")  # else empty tokens are all there is to drop
    parts = F.split(text, r"\s+")
    return _listed(F.when(odd, F.filter(parts, lambda x: x.rlike(r"[^\p{javaWhitespace}]"))).otherwise(F.filter(parts, lambda x: x != "")))


def pattern_tokens(pattern: str) -> Tokenizer:
    """A tokenizer that splits at a regular expression; empty tokens are dropped."""
    return lambda text: F.filter(_listed(F.split(text, pattern)), lambda x: F.trim(x) != "")


@dataclass(frozen=True)
class Step:
    """Part of a normalizer: `change` makes a token into another one, `keeps` says whether that stays (null: it doesn't).

    `whole`: whether change(text) changes each token of the text as change(token) would.
    """

    change: Callable[[Column], Column] | None = None
    keeps: Callable[[Column], Column] | None = None
    whole: bool = False


class Normalizer:
    """Steps from left to right; a token that one drops stays dropped. No steps: the token as it is.

    Called with a token it gives the token or null. `over` applies it to an array of tokens: one transform for
    the changes up to a test, one filter for the tests, so that nothing is evaluated twice.
    """

    def __init__(self, *steps: Step):
        self.steps = steps

    def __call__(self, token: Column) -> Column:
        for step in self.steps:
            if step.change:
                token = step.change(token)
            if step.keeps:
                token = let(token, _kept_by(step.keeps))
        return token

    def over(self, tokens: Column, steps: tuple[Step, ...] | None = None) -> Column:
        changes: list = []
        tests: list = []

        def settled(tokens: Column) -> Column:
            nonlocal changes, tests
            made, held = tuple(changes), tuple(tests)
            changes, tests = [], []
            tokens = F.transform(tokens, lambda x: _applied(made, x)) if made else tokens
            return F.filter(tokens, lambda x: reduce(and_, (f(x) for f in held))) if held else tokens

        for step in self.steps if steps is None else steps:
            if step.change:
                if tests:
                    tokens = settled(tokens)
                changes.append(step.change)
            if step.keeps:
                tests.append(step.keeps)
        return settled(tokens)


def _applied(functions, x: Column) -> Column:
    return reduce(lambda value, f: f(value), functions, x)


def _kept_by(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(test(x), x)


def _there(token: Column) -> Column:
    return token != ""


_LOWER = Step(F.lower, whole=True)
_TRIM = Step(lambda token: F.regexp_replace(token, EDGES, ""), _there)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and those bases (Hangul syllables aren't among them)."""
    pairs = []
    for code in range(0xC0, 0x30000):
        c = chr(code)
        if not 0xAC00 <= code <= 0xDFFF and (whole := unicodedata.normalize("NFD", c)) != c:
            rest = "".join(x for x in whole if not unicodedata.category(x).startswith("M"))
            if len(rest) == 1:
                pairs.append((c, rest))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _jamo(text: Column) -> Column:
    """The text with Hangul syllables taken apart, by the arithmetic of their code points."""
    leads, vowels, tails = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def apart(c: Column) -> Column:
        s = F.ascii(c) - 0xAC00
        pick = lambda of, at: F.substring(F.lit(of), at.cast("int"), F.lit(1))
        parts = F.concat(pick(leads, F.floor(s / 588) + 1), pick(vowels, F.floor((s % 588) / 28) + 1), F.when(s % 28 > 0, pick(tails, s % 28)).otherwise(""))
        return F.when(c.between("가", "힣"), parts).otherwise(c)

    return F.when(text.rlike("[가-힣]"), F.array_join(F.transform(F.split(text, ""), apart), "")).otherwise(text)


def _folded(token: Column) -> Column:
    source, target = _folding()
    return F.regexp_replace(F.translate(_jamo(token), source, target), r"\p{M}+", "")


_FOLD = Step(_folded, _there, whole=True)

lowercase = Normalizer(_LOWER)
#: Without the characters at its edges that aren't a-z or 0-9 (capitals and accented letters among them).
trim_non_alphanumeric = Normalizer(_TRIM)
basic = Normalizer(_LOWER, _TRIM)
#: Canonically decomposed, without marks; case stays. A token of marks only is dropped.
fold_accents = Normalizer(_FOLD)


def stop_words(words: Iterable[str]) -> Normalizer:
    """Drops the tokens that are exactly one of the words."""
    known = sorted({w for w in words if w})
    return Normalizer(Step(keeps=lambda token: ~token.isin(known))) if known else Normalizer()


def custom(change: Callable[[Column], Column]) -> Normalizer:
    """Any function of a token; null drops it."""
    return Normalizer(Step(change, lambda token: token.isNotNull()))


def load_stop_words(path: str | None = None) -> frozenset[str]:
    """Words of a file, one a line, trimmed; path None: the file that IR_STOPWORDS_PATH names, or no words.

    `classpath:` and a bare name of BUNDLED mean the lists that come with this package, `file:` or any other path a file.
    What is named but can't be read is an error.
    """
    path = path or os.environ.get("IR_STOPWORDS_PATH")
    if not path:
        return frozenset()
    bare = path.removeprefix("classpath:").lstrip("/")
    if bare in BUNDLED and not path.startswith("file:"):
        return frozenset(BUNDLED[bare])
    if path.startswith("classpath:"):
        raise FileNotFoundError(f"no such bundled list: {bare}")
    return frozenset(w for line in Path(path.removeprefix("file:")).read_text(encoding="utf-8").splitlines() if (w := line.strip()))


def chain(*normalizers: Normalizer | Callable[[Column], Column]) -> Normalizer:
    """The normalizers from left to right; a token that one drops stays dropped. None: the token as it is."""
    return Normalizer(*(step for n in normalizers for step in (n if isinstance(n, Normalizer) else custom(n)).steps))


minimal = chain(lowercase, trim_non_alphanumeric)
english = chain(lowercase, trim_non_alphanumeric, stop_words(ENGLISH))
#: Accents are folded before stop words are looked up, so stop words with accents only match their unaccented twins.
spanish = chain(lowercase, fold_accents, trim_non_alphanumeric, stop_words(SPANISH))
PIPELINES: dict[str, Normalizer] = {"minimal": minimal, "english": english, "spanish": spanish}


def terms(text: Column, normalizer: Normalizer = english, tokenizer: Tokenizer = whitespace_tokens) -> Column:
    """The normalized tokens of a text that aren't dropped or blank, in order.

    Changes that work on whole texts as on tokens are made to the text. If trimming follows, the trimmed tokens are
    found in the text: one pass over it instead of one for each token.
    """
    normalizer = normalizer if isinstance(normalizer, Normalizer) else custom(normalizer)
    steps = list(normalizer.steps)
    if tokenizer is whitespace_tokens:
        whole = []
        while steps and steps[0].whole:
            whole.append(steps.pop(0))
        if steps and steps[0] is _TRIM:
            text = _applied([s.change for s in whole], text)
            tokens = _listed(F.regexp_extract_all(text, F.lit(TRIMMED), F.lit(0)))
            rest = Normalizer(*steps[1:])
            return rest.over(tokens) if not any(s.change for s in steps[1:]) else F.filter(rest.over(tokens), _told)
    return F.filter(normalizer.over(tokenizer(text)), _told)


def _told(token: Column) -> Column:
    return token.isNotNull() & (F.trim(token) != "")
