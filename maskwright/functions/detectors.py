"""Detectors: what turns texts into spans.

A native detector maps a text Column to a span Column. A Python detector, for what no expression can do (large term
lists, models), maps a string to tuples in worker processes, an Arrow batch at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import PRIORITY, SPANS, WORD, regex_spans

EMAIL = rf"(?<![{WORD}.+-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{{2,}}"
MENTION = rf"(?<![{WORD}.@/])@[A-Za-z][{WORD}.\-]{{2,}}"
ACCOUNT = r"\[~accountid:[A-Fa-f0-9:\-]+\]"
SHORT = rf"\[~[{WORD}.\-]+\]"
#: Annotations and at-rules of programming languages.
NOT_MENTIONS = (
    "Autowired Component Deprecated Inject NonNull Nullable Override SuppressWarnings abstract author charset classmethod dataclass deprecated final font-face "
    "import include keyframes media override param params property pytest pytest.fixture pytest.mark raise raises return returns see since staticmethod supports throw throws version"
).split()
RESERVED_TLDS = ("arpa", "invalid", "local", "localhost", "onion", "test")
#: Above so many terms one automaton replaces the alternation.
MANY_TERMS = 1000


@dataclass(frozen=True)
class Detector:
    """name, entity_type, and one of native (Column -> spans) and python (str -> [(start, end, text)])."""

    name: str
    entity_type: str
    native: Callable[[Column], Column] | None = None
    python: Callable[[], Callable[[str], list[tuple[int, int, str]]]] | None = None

    @property
    def priority(self) -> int:
        return PRIORITY[self.entity_type]


def valid_email(address: Column) -> Column:
    """Syntax rules on a match of EMAIL: lengths, dots, hyphens at label ends, reserved top-level domains."""
    local, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    return (
        (F.length(local) <= 64) & (F.length(address) <= 254) & ~F.contains(address, F.lit("..")) & ~local.endswith(".") & ~local.startswith(".")
        & ~domain.rlike(r"(^|\.)-|-(\.|$)|(^|\.)[^.]{64,}(\.|$)") & ~F.lower(F.substring_index(domain, ".", -1)).isin(*RESERVED_TLDS)
    )


def email_spans(text: Column) -> Column:
    return F.filter(regex_spans(text, EMAIL, "EMAIL", "email", needle="@"), lambda s: valid_email(s["text"]))


def handle_spans(text: Column) -> Column:
    def real(s: Column) -> Column:
        name = F.substring(s["text"], 2, 1 << 20)
        return ~name.isin(*NOT_MENTIONS) & ~F.substring_index(name, ".", 1).isin(*NOT_MENTIONS) & (F.substring(text, s["end"] + 1, F.lit(1)) != "/")

    mentions = F.filter(regex_spans(text, MENTION, "HANDLE", "handle", needle="@"), real)
    return F.concat(mentions, regex_spans(text, ACCOUNT, "HANDLE", "handle", needle="[~"), regex_spans(text, SHORT, "HANDLE", "handle", needle="[~"))


#: Country code -> (least, most digits of the national number, pattern it must match). A subset of the world's plans.
PLANS = {
    # area code not N11, N9X, 37X or 96X; exchange not N11
    "1": (10, 10, r"(?!.11|37|96)[2-9][0-8][0-9](?!.11)[2-9][0-9]{6}"),
    "49": (6, 11, r"[1-9][0-9]+"),
    "43": (7, 13, r"[1-9][0-9]+"),
    "41": (9, 9, r"[2-9][0-9]{8}"),
    "33": (9, 9, r"[1-9][0-9]{8}"),
    "34": (9, 9, r"[5-9][0-9]{8}"),
    "44": (9, 10, r"[1-37-9][0-9]+"),
}
REGIONS = {"US": "1", "CA": "1", "DE": "49", "AT": "43", "CH": "41", "FR": "33", "ES": "34", "GB": "44"}
PHONE = rf"(?<![{WORD}+./@\-])(?:\+|00|0)[1-9](?:[ ()/.\-]{{0,2}}[0-9]){{5,14}}(?![{WORD}@])"


def phone_spans(text: Column, region: str = "DE") -> Column:
    """Numbers with a country code of PLANS, and national ones with trunk prefix 0 of *region*."""
    home = REGIONS.get(region.upper())
    if home is None:
        raise ValueError(f"unknown region {region!r}; known: {', '.join(sorted(REGIONS))}")

    def valid(s: Column) -> Column:
        digits = F.regexp_replace(s["text"], "[^0-9]", "")
        abroad = s["text"].startswith("+") | s["text"].startswith("00")
        world = F.regexp_replace(digits, "^00", "")
        checks = []
        for code, (least, most, form) in PLANS.items():
            n = F.substring(world, len(code) + 1, 20)
            n = F.regexp_replace(n, "^0", "") if code in ("49", "43", "44") else n
            checks.append(world.startswith(code) & F.length(n).between(least, most) & n.rlike(f"^{form}$"))
        any_ = checks[0]
        for c in checks[1:]:
            any_ = any_ | c
        least, most, form = PLANS[home]
        n = F.substring(digits, 2, 20)
        local = F.length(n).between(least, most) & n.rlike(f"^{form}$") if home not in ("1", "34") else F.lit(False)
        return (abroad & any_) | (~abroad & local)

    return F.filter(regex_spans(text, PHONE, "PHONE", "phone"), valid)


def clean_terms(terms: list[str]) -> list[str]:
    """Composed, without blanks and repeats, longest first."""
    return sorted({unicodedata.normalize("NFC", t) for t in terms if t}, key=lambda t: (-len(t), t))


def term_spans(text: Column, terms: list[str]) -> Column:
    """Case-sensitive substrings: leftmost, longest first, not overlapping."""
    pattern = "|".join(re.sub(r"([\\^$.|?*+()\[\]{}&~#\s-])", r"\\\1", t) for t in clean_terms(terms))
    return regex_spans(text, pattern, "TERM", "denylist")


def composed(text: str) -> tuple[str, list[int] | None]:
    """The composed text, and for each of its characters and its end the offset in *text*; None where they agree.

    A run that begins with a character of combining class 0 is composed by itself, so offsets map run by run.
    """
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, at, start = [], [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or unicodedata.combining(text[i]) == 0 and unicodedata.normalize("NFC", text[start:i] + text[i]) == unicodedata.normalize("NFC", text[start:i]) + unicodedata.normalize("NFC", text[i]):
            run = unicodedata.normalize("NFC", text[start:i])
            out.append(run)
            at += [start] * len(run)
            start = i
    return "".join(out), [*at, len(text)]


def term_automaton(terms: list[str]) -> Callable[[], Callable[[str], list[tuple[int, int, str]]]]:
    """All matches, overlapping ones too, of a long term list, by an automaton built once per worker."""
    wanted = clean_terms(terms)

    def build() -> Callable[[str], list[tuple[int, int, str]]]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in wanted:
            automaton.add_word(t, len(t))
        automaton.make_automaton()

        def find(text: str) -> list[tuple[int, int, str]]:
            c, at = composed(text)
            hits = [(end - n + 1, end + 1) for end, n in automaton.iter(c)]
            if at is None:
                return [(a, b, c[a:b]) for a, b in hits]
            return [(at[a], at[b], text[at[a] : at[b]]) for a, b in hits if at[a] < at[b]]

        return find

    return build


def person_detector(model: Callable[[], Callable[[str], list[tuple[int, int, float]]]], threshold: float = 0.5) -> Detector:
    """Persons by a model: a factory, called once per worker, of text -> [(start, end, score)]. Offsets beyond the text
    or empty are dropped; blank texts aren't shown to the model."""

    def build() -> Callable[[str], list[tuple[int, int, str]]]:
        predict = model()

        def find(text: str) -> list[tuple[int, int, str]]:
            if not text.strip():
                return []
            return [(a, b, text[a:b]) for a, b, score in predict(text) if score >= threshold and 0 <= a < b <= len(text)]

        return find

    return Detector("ner", "PERSON", python=build)


def build_detectors(terms: list[str] | None = None, region: str = "DE", person: Detector | None = None) -> list[Detector]:
    """E-mail, phone, handle, then terms and persons where given."""
    out = [
        Detector("email", "EMAIL", native=email_spans),
        Detector("phone", "PHONE", native=lambda t: phone_spans(t, region)),
        Detector("handle", "HANDLE", native=handle_spans),
    ]
    wanted = clean_terms(terms or [])
    if len(wanted) > MANY_TERMS:
        out.append(Detector("denylist", "TERM", python=term_automaton(wanted)))
    elif wanted:
        out.append(Detector("denylist", "TERM", native=lambda t: term_spans(t, wanted)))
    return out + ([person] if person else [])


def python_spans(chunks: Column, detectors: list[Detector]) -> Column:
    """Spans of Python detectors for an array of texts: an array of span arrays."""
    plan = [(d.name, d.entity_type, d.priority, d.python) for d in detectors if d.python]

    @F.pandas_udf(f"array<{SPANS}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = [(name, kind, rank, build()) for name, kind, rank, build in plan]
        for s in batches:
            yield s.map(
                lambda texts: None if texts is None else [
                    [dict(start=a, end=b, text=x, entity_type=kind, detector_name=name, priority=rank) for name, kind, rank, f in ready for a, b, x in f(t)]
                    for t in texts
                ]
            )

    return find.asNondeterministic()(chunks)  # so that no rewrite copies the call


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda rows: None if rows is None else [[unicodedata.normalize("NFC", x) for x in row] for row in rows])


def nfc(values: Column) -> Column:
    """Composed forms of nested strings."""
    return _nfc.asNondeterministic()(values)  # so that no rewrite copies the call
