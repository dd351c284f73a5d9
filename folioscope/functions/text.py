"""Text functions as Column expressions.

All of them run inside the JVM; none needs a Python worker.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZWSP = "​"

#: Classes of sensitive strings.
SENSITIVE = {
    "api_key": r"""(?i)\b(?:api[-_]?key|token|auth|password|secret|pwd)\s*[:=]\s*["']?[A-Za-z0-9\-_./+=]{16,}["']?""",
    "email": r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "ssh_key": r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9\-_.=]{20,}\b",
}
#: Markers of roles and chat templates.
ROLE_MARKERS = [
    "system:", "user:", "assistant:", "developer:", "sistema:", "usuario:", "asistente:",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "### Instruction", "### Response", "### System",
]
#: Phrases of an answer that declines.
ABSTENTION = [
    "seems empty", "oracle is silent", "no relevant", "couldn't find", "could not find", "do not have", "don't have", "not in the vault", "no information",
    "i don't know", "i do not know", "cannot answer", "can't answer", "unable to", "nothing in the vault", "no mention", "isn't anything", "is not anything",
]
#: Words that point at an earlier turn, and words that continue it.
REFERENTIAL = (
    "it its itself they them their theirs he him his she her hers that this these those there then such same one ones former latter "
    "ella ellos ellas eso esto esa ese esas esos aquel aquella aquello su sus le les ahi alli alla entonces"
).split()
REFERENTIAL_ACCENTED = ["él", "aquí", "ahí", "allí", "allá"]
OPENERS = ["and", "y", "but", "pero", "or", "o", "so", "then", "entonces", "también", "tambien"]
SHORT_QUESTION = 5


def _folding() -> tuple[str, str]:
    """Letters with a canonical decomposition to one ASCII letter, and that letter."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def strip_accents(text: Column) -> Column:
    """Accented Latin letters as plain ones; the rest as it is."""
    return F.translate(text, ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Plain lower-case ASCII: accents folded, what is left beyond ASCII dropped."""
    return F.lower(F.regexp_replace(strip_accents(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F]", ""))


def tag_name(text: Column) -> Column:
    """A tag in canonical form: plain lower-case words joined by hyphens."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.trim(text))), r"[^a-z0-9]+", "-"), F.lit("-"))


def tokens(text: Column) -> Column:
    """Words of the full-text index: runs of letters and digits, folded."""
    return F.array_remove(F.split(F.lower(strip_accents(text)), r"[^\p{L}\p{N}]+"), "")


def title_tokens(title: Column) -> Column:
    """Distinct comparison tokens of a title without its anchor."""
    return F.array_distinct(F.regexp_extract_all(fold(F.substring_index(title, "#", 1)), F.lit(r"([a-z0-9]+)"), 1))


def title_matches(expected: Column, got: Column) -> Column:
    """Whether all tokens of the expected title are among those of the other."""
    e = title_tokens(expected)
    return (F.size(e) > 0) & (F.size(F.array_except(e, title_tokens(got))) == 0)


def wikilinks(body: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|alias]]``."""
    return F.regexp_extract_all(body, F.lit(r"\[\[([^\[\]|]+?)(?:\|[^\[\]]*)?\]\]"), 1)


def citations(text: Column) -> Column:
    """Labels of ``[[label]]``."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), 1)


def split_anchor(target: Column) -> tuple[Column, Column]:
    """Title and anchor of ``Title#anchor``; no anchor gives null."""
    parts = F.split(target, "#", 2)
    return F.trim(F.get(parts, 0)), F.nullif(F.trim(F.coalesce(F.get(parts, 1), F.lit(""))), F.lit(""))


def sensitive_classes(text: Column) -> Column:
    """Names of the classes of sensitive strings in a text."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in SENSITIVE.items())))


def sanitize_prompt(text: Column) -> Column:
    """A zero-width space after the first character of each role marker."""
    # one pass, alternatives in order; most places are passed by their first characters
    first, two = ("|".join(sorted({re.escape(m[:n].lower()) for m in ROLE_MARKERS})) for n in (1, 2))
    pattern = f"(?i)(?=[{first.replace('|', '')}])(?={two})(?:" + "|".join(f"(?:(?<m{k}>{re.escape(m[0])})(?<t{k}>{re.escape(m[1:])}))" for k, m in enumerate(ROLE_MARKERS)) + ")"
    firsts = "".join(f"${{m{k}}}" for k in range(len(ROLE_MARKERS)))
    rests = "".join(f"${{t{k}}}" for k in range(len(ROLE_MARKERS)))
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{firsts}{ZWSP}{rests}"))


def wrap_untrusted(text: Column, label: str = "note") -> Column:
    """Text between tags of a label, tags of that label inside it broken."""
    safe = F.replace(text, F.lit(f"</{label}>"), F.lit(f"<{ZWSP}/{label}>"))
    safe = F.replace(safe, F.lit(f"<{label}>"), F.lit(f"<{ZWSP}{label}>"))
    return F.concat(F.lit(f"<{label}>\n"), safe, F.lit(f"\n</{label}>"))


def redact(text: Column, most: int = 160) -> Column:
    """A text for a log line: no control characters, one line, secrets replaced, cut."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), SENSITIVE.values(), out)
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 1), F.lit("…"))).otherwise(out)


def source_label(title: Column, page: Column, heading: Column) -> Column:
    """Title with the best anchor: the page, else the heading."""
    clean = F.substring(F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), r"\s+", " ")), 1, 80)
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(title, F.lit("#p."), page.cast("string"))).when(clean != "", F.concat(title, F.lit("#"), clean)).otherwise(title)


def snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def file_slug(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9-]+", "_"), F.lit("_")), 1, 60)


def thread_slug(text: Column) -> Column:
    """The first six words joined by hyphens."""
    return F.array_join(F.slice(F.regexp_extract_all(fold(text), F.lit(r"([a-z0-9]+)"), 1), 1, 6), "-")


def abstained(answer: Column) -> Column:
    """Whether an answer is empty or has a phrase that declines."""
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return (text == "") | reduce(lambda a, c: a | F.contains(text, F.lit(c)), ABSTENTION, F.lit(False))


def keyword_found(answer: Column, keyword: str) -> Column:
    """Whether a keyword begins at a word of the answer, separators being free."""
    plain = unicodedata.normalize("NFKD", keyword).encode("ascii", "ignore").decode().lower()
    parts = re.findall(r"[a-z0-9]+", plain)
    return fold(answer).rlike(r"\b" + r"[\W_]+".join(parts)) if parts else F.lit(False)


def needs_rewrite(question: Column, has_history: Column) -> Column:
    """Whether a question may depend on earlier turns."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(\p{L}+)"), 1)
    plain = F.transform(words, fold)
    points = (
        (F.size(words) < SHORT_QUESTION)
        | F.array_contains(F.array(*map(F.lit, OPENERS)), F.coalesce(F.get(words, 0), F.lit("")))
        | F.arrays_overlap(words, F.array(*map(F.lit, REFERENTIAL_ACCENTED)))
        | F.arrays_overlap(plain, F.array(*map(F.lit, REFERENTIAL)))
    )
    return has_history & points


def mentions(text: Column) -> Column:
    """Names after an ``@`` at the start or after white space."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|\s)@([\w./-]+)"), 1)


def sidecar_path(vault: str, folder: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(vault), F.lit(folder), F.concat(path, F.lit(".md")))


def severity(text: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(s.isin("low", "medium", "high"), s).otherwise("medium")


def event_value(value: Column) -> Column:
    """A log value, quoted as JSON when it could not be split otherwise."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    return F.when(value.rlike(r"[ \t\n=]"), quoted).otherwise(value)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("int")


def locate_claim(body: Column, claim: Column) -> Column:
    """0-based place of a claim in a body: exact, else without case; else null."""
    exact, loose = F.instr(body, claim), F.instr(F.lower(body), F.lower(claim))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)


def paragraph_around(body: Column, start: Column, end: Column) -> Column:
    """The paragraph, between blank lines, that holds a span of 0-based places."""
    before = F.substring(body, F.lit(1), start)
    after = F.substring(body, end + 1, F.length(body))
    head = F.substring_index(before, "\n\n", -1)
    tail = F.substring_index(after, "\n\n", 1)
    return F.trim(F.concat(head, F.substring(body, start + 1, end - start), tail))
