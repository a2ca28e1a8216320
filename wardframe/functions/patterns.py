"""Fixed detection values and the Java patterns built from them.

The rule vocabulary is written as plain word lists. `word_pattern` turns a list of word groups
into one Java pattern whose meaning is that of an RE2 pattern with ASCII word boundaries and
simple Unicode case folding: every letter becomes an explicit class, so that neither the
locale-dependent folding of `(?iu)` nor Java's notion of a word character can change a match.
"""

import string
from dataclasses import dataclass

# Injection rules. Each rule is word groups in order, with the longest allowed gap
# (in characters) between neighbouring groups. A trailing "?" makes the letter before it optional.


@dataclass(frozen=True)
class Rule:
    rule_id: int
    type: str
    severity: str
    confidence: int
    groups: tuple
    gaps: tuple


RULES = (
    Rule(1, "IGNORE_PREVIOUS_INSTRUCTIONS", "HIGH", 95,
         (("ignore", "disregard", "forget"),
          ("previous", "prior", "earlier", "above"),
          ("instructions?", "rules?", "prompt")), (40, 30)),
    Rule(2, "SYSTEM_PROMPT_EXTRACTION", "HIGH", 90,
         (("reveal", "show", "print", "output", "repeat", "expose"),
          ("system prompt", "developer message", "hidden instructions?")), (40,)),
    Rule(3, "ROLE_OVERRIDE", "MEDIUM", 75,
         (("you are now", "act as", "pretend to be"),
          ("unrestricted", "developer mode", "jailbroken", "no rules")), (60,)),
    Rule(4, "DATA_EXFILTRATION", "CRITICAL", 95,
         (("export", "dump", "retrieve", "send", "list"),
          ("all", "every"),
          ("customers?", "users?", "records?", "credentials?", "secrets?")), (60, 30)),
    Rule(5, "MULTILINGUAL_INSTRUCTION_OVERRIDE", "HIGH", 90,
         (("ignora", "olvida"),
          ("instrucciones", "reglas"),
          ("anteriores", "previas")), (50, 30)),
    Rule(6, "MULTILINGUAL_PROMPT_EXTRACTION", "HIGH", 90,
         (("revela", "muestra", "imprime"),
          ("prompt del sistema", "instrucciones ocultas")), (50,)),
    Rule(7, "MULTILINGUAL_INSTRUCTION_OVERRIDE", "HIGH", 90,
         (("ignore", "oublie"),
          ("instructions", "règles", "regles"),
          ("précédentes", "precedentes", "antérieures", "anterieures")), (50, 30)),
    Rule(8, "MULTILINGUAL_PROMPT_EXTRACTION", "HIGH", 90,
         (("révèle", "revele", "montre", "affiche"),
          ("prompt système", "prompt systeme", "instructions cachées", "instructions cachees")),
         (50,)),
)

ENCODED_RULE = Rule(9, "ENCODED_PROMPT_INJECTION", "HIGH", 90, (), ())

# Phrases that frame quoted text as discussion.
DISCUSSION_MARKERS = (
    "article says",
    "article states",
    "common attack phrase",
    "attack phrase",
    "example of",
    "example:",
    "quoted phrase",
    "security training",
    "prompt injection example",
    "phrase means",
)

# Cyrillic look-alikes and the Latin letters they stand for.
HOMOGLYPHS = "аеорсхАЕОРСХ"
HOMOGLYPH_LETTERS = "aeopcxAEOPCX"

# White space of the normalization (control spaces, NEL, category Z).
_SPACE = r"\t\n\x0B\f\r\x{85}\p{Z}"
OTHER_SPACE = rf"[{_SPACE}&&[^ ]]"
ASCII_SPACES = "\t\n\x0b\f\r"
# The same white space spelled out, for trimming.
SPACES = ("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
          + "".join(chr(c) for c in range(0x2000, 0x200B)))
FORMAT_CHARS = r"\p{Cf}+"

# Classes are spelled out letter by letter: Java then tests them with one table lookup instead of
# a chain of range checks, which halves the cost per character.
_W = f"[{string.digits}{string.ascii_letters}_]"
_B64 = f"[{string.ascii_letters}{string.digits}+/]"
START = f"(?<!{_W})"
END = f"(?!{_W})"
EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# Other letters that fold to an ASCII letter (long s, Kelvin sign).
_FOLDS = {"s": "ſ", "k": "K"}

# Candidate, quotation, personal-data and secret shapes.
BASE64_RUN = EDGE + _B64 + "{24,}={0,2}" + EDGE
BASE64_HINT = f"(?<!{_B64}){_B64}{{24}}"
QUOTED = "\"[^\"]*\"|'[^']*'"
# The local part may only start where no earlier start could reach the same "@"; this keeps long
# runs without "@" linear in a backtracking engine and changes no match.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@"
         r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
_SEP = r"[-.\t\n\f\r ]?"
PHONE = (EDGE + rf"(?:\+?1{_SEP})?(?:\(?[0-9]{{3}}\)?{_SEP})[0-9]{{3}}{_SEP}[0-9]{{4}}" + EDGE)
SSN = EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + EDGE
PHONE_HINT = r"[0-9]{4}"
ACCESS_KEY = EDGE + r"AKIA[0-9A-Z]{16}" + EDGE


def _fold_letter(ch: str) -> str:
    if not ch.isalpha():
        return ch
    return "[" + ch + ch.upper() + _FOLDS.get(ch, "") + "]"


def _any_word(words) -> str:
    return "(?:" + "|".join("".join(_fold_letter(c) for c in w) for w in words) + ")"


def word_pattern(rule: Rule) -> str:
    """Java pattern of a rule over normalized text (which holds no line break)."""
    out = ["(?s)"]
    for i, words in enumerate(rule.groups):
        if i:
            out.append(".{0,%d}" % rule.gaps[i - 1])
        out.append(START + _any_word(words) + END)
    return "".join(out)


def word_stems(words) -> list:
    """Substrings of which at least one must occur (lower case) for a group to match."""
    stems = {w[:-2] if w.endswith("?") else w for w in words}
    return [s for s in sorted(stems) if not any(o != s and o in s for o in stems)]


RULE_PATTERNS = {r.rule_id: word_pattern(r) for r in RULES}
