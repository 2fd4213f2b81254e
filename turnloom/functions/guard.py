"""Prompt-injection guard as column expressions: detect, neutralise, mask, redact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X

# Fixed values -----------------------------------------------------------------
INVISIBLE = (r"[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}"
             r"\x{2066}-\x{2069}\x{feff}\x{e0000}-\x{e007f}]")
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"
FAMILIES = {
    "instruction_override": (
        r"(?:\b(?:ignore|disregard|forget|override|bypass|discard|countermand)\b"
        r"[\s,]+(?:\w+\s+){0,3}"
        r"\b(?:instructions?|prompts?|rules?|directives?|polic(?:y|ies)|guidelines?|"
        r"constraints?|system\s+prompt)\b)"
        r"|\bnew\s+system\s+prompt\b"
        r"|\b(?:do\s+not|don'?t|never)\s+follow\b[\s,]+(?:\w+\s+){0,4}"
        r"\b(?:instructions?|rules?|prompts?|system)\b"
        r"|\b(?:ignore|disregard)\s+(?:all\s+|any\s+)?(?:previous|prior|earlier|above|preceding)\b"
        r"|\bsystem\s+prompt\s+(?:override|replacement)\b"),
    "role_assumption": (
        r"\byou\s+are\s+now\s+(?:an?\s|the\s|unrestricted|unfiltered|uncensored|free|"
        r"no\s+longer|operating|running|in\s+\w+\s+mode|jailbroken|dan\b)"
        r"|\bact\s+as\s+(?:an?\s|the\s)?(?:system|developer|admin(?:istrator)?|root|"
        r"unrestricted|jailbroken|dan)\b"
        r"|\bpretend\s+(?:to\s+be|you\s+are)\b"
        r"|\b(?:developer|god|jailbreak|unrestricted)\s+mode\b"
        r"|\bfrom\s+now\s+on\s+you\b"
        r"|\byou\s+have\s+no\s+(?:rules|restrictions|limitations|guidelines|guardrails)\b"
        r"|\b(?:you\s+are|behave\s+as)\s+(?:not\s+bound|above)\b"),
    "prompt_exfiltration": (
        r"\b(?:reveal|print|repeat|show|output|display|leak|expose|dump|echo|recite)\b"
        r"[\s,]+(?:\w+\s+){0,4}"
        r"\b(?:system\s+prompt|instructions?|secrets?|api[\s_-]?keys?|credentials?|"
        r"passwords?|tokens?|configuration|env(?:ironment)?\s+variables?)\b"
        r"|\b(?:reply|respond|answer|start)\b[\s,]+with[\s,]+(?:\w+\s+){0,3}"
        r"\b(?:system\s+prompt|instructions?|secrets?|api[\s_-]?keys?|credentials?)\b"
        r"|\bwhat\s+(?:is|are)\s+your\s+(?:system\s+prompt|instructions|rules|secrets?)\b"
        r"|\byour\s+(?:hidden|initial|original)\s+(?:instructions?|prompt)\b"),
    "delimiter_breakout": (
        r"<\s*/?\s*(?:retrieved_memory|retrieved_history|memory|history|system|user|"
        r"assistant|tool|developer)\s*>"
        r"|<\|/?\s*(?:im_start|im_end|system|user|assistant|endoftext|eot_id)\s*\|>"
        r"|<<\s*/?\s*SYS\s*>>"
        r"|\[\s*/?\s*(?:INST|SYS|SYSTEM)\s*\]"
        r"|###\s*(?:system|instruction|human|assistant)\b"
        r"|\[\s*(?:system|assistant)\s*\]\s*:"),
    "role_smuggling": r"^\s*(?:system|assistant|developer|tool|function)\s*:\s*",
    "credential_exfiltration": (
        r"\b(?:send|post|upload|email|transmit|exfiltrate|forward|leak|paste)\b"
        r"[\s,]+(?:\w+\s+){0,6}"
        r"\b(?:api[\s_-]?keys?|credentials?|secrets?|passwords?|tokens?)\b"
        r"|\b(?:curl|wget|fetch|http[_ ]?(?:get|post))\s*[:\(]?\s*https?://"
        r"|\bhttps?://\S*\b(?:key|token|secret|password)=\S+"),
    "policy_bypass": (
        r"\b(?:safety|content|usage)\s+(?:guidelines?|polic(?:y|ies)|rules?)\s+"
        r"(?:do\s+not|don'?t|no\s+longer|never)\s+apply\b"
        r"|\bno\s+(?:restrictions|limitations|guardrails|filters|safety)\b"
        r"|\bdisable\s+(?:your\s+|all\s+)?(?:safety|filters?|guardrails?|restrictions?|checks?)\b"
        r"|\bwithout\s+(?:any\s+)?(?:restrictions|guardrails|safety|filters)\b"
        r"|\bsystem\s+override\b"),
}
COMPACT_PHRASES = {
    "instruction_override": [
        "ignorepreviousinstructions", "ignoreallpreviousinstructions",
        "disregardpreviousinstructions", "forgetyourinstructions", "overridethesystemprompt",
        "newsystemprompt", "systempromptoverride"],
    "role_assumption": [
        "youarenowunrestricted", "youarenowdan", "youarenolongerbound", "actasthesystem",
        "pretendtobethesystem", "developermodeenabled", "jailbreakmode"],
    "prompt_exfiltration": [
        "revealsystemprompt", "printyourinstructions", "revealtheapikey", "showmethesecrets"],
    "credential_exfiltration": ["sendtheapikeyto", "exfiltratethecredentials"],
    "policy_bypass": ["noguardrails", "norestrictionsapply", "disablesafetychecks"],
}
_OBJECTS = ["instruction", "secret", "apikey", "api key", "api_key", "api-key", "credential"]
_LINKS = ["http://", "https://"]
# What every match of a family holds once folded, where white space is one blank: one list of groups per way, a word of each group.
ANCHORS = {
    "instruction_override": [
        [["ignore", "disregard", "forget", "override", "bypass", "discard", "countermand"],
         ["instruction", "prompt", "rule", "directive", "polic", "guideline", "constraint"]],
        [["system prompt"]],
        [["do not follow", "don't follow", "dont follow", "never follow"], ["instruction", "rule", "prompt", "system"]],
        [["ignore", "disregard"], ["previous", "prior", "earlier", "above", "preceding"]]],
    "role_assumption": [
        [["you are now ", "from now on you", "you have no ", "developer mode", "god mode", "jailbreak mode", "unrestricted mode",
          "pretend to be", "pretend you are", "you are not bound", "you are above", "behave as not bound", "behave as above"]],
        [["act as "], ["system", "developer", "admin", "root", "unrestricted", "jailbroken", "dan"]]],
    "prompt_exfiltration": [
        [["reveal", "print", "repeat", "show", "output", "display", "leak", "expose", "dump", "echo", "recite"],
         ["system prompt", *_OBJECTS, "password", "token", "configuration", " variable"]],
        [["reply", "respond", "answer", "start"], ["with"], ["system prompt", *_OBJECTS]],
        [["what is your ", "what are your "], ["system prompt", "instructions", "rules", "secret"]],
        [["your hidden ", "your initial ", "your original "], ["instruction", "prompt"]]],
    "delimiter_breakout": [
        [["<"], [">"]], [["["], ["]"], ["inst", "sys", "assistant"]], [["###"], ["system", "instruction", "human", "assistant"]]],
    "role_smuggling": [[[":"], ["system", "assistant", "developer", "tool", "function"]]],
    "credential_exfiltration": [
        [["send", "post", "upload", "email", "transmit", "exfiltrate", "forward", "leak", "paste"],
         [*_OBJECTS, "password", "token"]],
        [_LINKS, ["curl", "wget", "fetch", "httpget", "http get", "http_get", "httppost", "http post", "http_post"]],
        [_LINKS, ["key=", "token=", "secret=", "password="]]],
    "policy_bypass": [
        [[" apply"], ["safety", "content", "usage"], ["guideline", "polic", "rule"]],
        [["no restrictions", "no limitations", "no guardrails", "no filters", "no safety", "system override"]],
        [["disable "], ["safety", "filter", "guardrail", "restriction", "check"]],
        [["without "], ["restrictions", "guardrails", "safety", "filters"]]],
}
STRUCTURAL = ["delimiter_breakout", "role_smuggling"]
DELIMITER = (r"<\s*/?\s*(?:retrieved_memory|retrieved_history|memory|history|system|user|"
             r"assistant|tool|developer)\s*>")
TEMPLATE_MARKER = (r"<\|/?\s*(?:im_start|im_end|system|user|assistant|endoftext|eot_id)\s*\|>"
                   r"|<<\s*/?\s*SYS\s*>>"
                   r"|\[\s*/?\s*(?:INST|SYS|SYSTEM)\s*\]"
                   r"|###\s*(?:system|instruction|human|assistant)\b")
ROLE_PREFIX = r"^[^\S\n]*(?:system|assistant|developer|tool|function|user)[^\S\n]*:[^\S\n]*"
HISTORY_ROLES = ("user", "assistant")
PRIVILEGED_ROLES = ("system", "tool", "developer", "function")
REDACTION_MARKER = "[redacted]"
SECRET_FIELDS = ["api_key", "apikey", "api_secret", "authorization", "credential", "credentials",
                 "password", "passwd", "secret", "secret_key", "token", "access_token",
                 "auth_token", "refresh_token", "client_secret", "private_key", "session_key"]
BEARER = r"(?i)(\bbearer\s+)\S+"
KEY_VALUE = (r"(?i)(\b(?:api[_-]?key|authorization|password|secret|token|access[_-]?token|"
             r"auth[_-]?token|client[_-]?secret|refresh[_-]?token)\b\s*[=:]\s*)\S+")
SHORT_KEY = r"\bsk-[A-Za-z0-9][A-Za-z0-9_-]{3,}\b"
# ------------------------------------------------------------------------------

INTENT = [name for name in FAMILIES if name not in STRUCTURAL]
_FLAGS = "(?imd)"
# Letters whose folding stays a letter: such text matches folded whenever it matches as is.
_LATIN_ONLY = r"^[\x{9}\x{a}\x{d}\x{20}-\x{7e}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{131}]*$"


def _regex(pattern: str) -> str:
    """Word characters and edges count letters of every script."""
    pattern = pattern.replace(r"\w", r"[\p{L}\p{N}_]")
    return _FLAGS + pattern


_L = X.lit_sql


def strip_invisible_sql(x: str) -> str:
    """Nothing invisible is ASCII, so plain text is left as it is."""
    return f"CASE WHEN octet_length({x}) = length({x}) THEN {x} ELSE regexp_replace({x}, {_L(INVISIBLE)}, '') END"


def contains_invisible(x: str) -> Column:
    return F.expr(f"rlike({x}, {_L(INVISIBLE)})")


def detection_variants(frame: DataFrame, text: str) -> DataFrame:
    """Add the four spellings detection reads: visible, spaced, folded and squeezed."""
    frame = frame.withColumn("_visible", F.expr(strip_invisible_sql(f"coalesce({text}, '')")))
    frame = frame.withColumn("_spaced", F.expr(f"regexp_replace(_visible, {_L(CONTROL)}, ' ')"))
    frame = frame.withColumn("_folded", X.normalize_text("_spaced"))
    return frame.withColumn("_squeezed", F.expr("replace(_folded, ' ', '')"))


def _any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_L(w)})" for w in words) + ")"


def _anchored_sql(name: str) -> str:
    """Whether a family can match any of the spellings; searching for words is far cheaper than its pattern."""
    return " OR ".join("(" + " AND ".join(_any_of("_folded", group) for group in way) + ")" for way in ANCHORS[name])


def _families_sql() -> str:
    hits = []
    for name, pattern in FAMILIES.items():
        regex = _L(_regex(pattern))
        found = f"rlike(_folded, {regex})"
        own = f"rlike(_visible, {regex}) OR (_spaced <> _visible AND rlike(_spaced, {regex}))"
        # Line starts exist only before folding.
        found += f" OR {own}" if pattern.startswith("^") else f" OR (NOT rlike(_visible, {_L(_LATIN_ONLY)}) AND ({own}))"
        found = f"(({_anchored_sql(name)}) AND ({found}))"
        if name in COMPACT_PHRASES:
            found = f"{_any_of('_squeezed', COMPACT_PHRASES[name])} OR {found}"
        hits.append(f"CASE WHEN {found} THEN {_L(name)} END")
    return f"array_compact(array({', '.join(hits)}))"


def detect_injection(frame: DataFrame, text: str, out: str = "families") -> DataFrame:
    """Add attack families in reporting order; an empty array means nothing matched."""
    return detection_variants(frame, text).withColumn(out, F.expr(_families_sql())).drop(
        "_visible", "_spaced", "_folded", "_squeezed")


def intent_of(families: Column) -> Column:
    return F.filter(families, lambda f: f.isin(*INTENT))


def survives_guard_sql(x: str) -> str:
    """Whether any text is left after the guard; plain prose needs no rewriting to know."""
    bare = (f"regexp_replace(regexp_replace(regexp_replace({strip_invisible_sql(x)}, {_L(CONTROL)}, ' '), "
            f"{_L('(?i)' + DELIMITER)}, ''), {_L('(?i)' + TEMPLATE_MARKER)}, '')")
    lines = f"regexp_replace(translate({bare}, '\\r', '\\n'), {_L(_FLAGS + ROLE_PREFIX)}, '')"
    return (f"CASE WHEN NOT rlike({x}, {_L('[<' + chr(92) + '[#:]|' + CONTROL + '|' + INVISIBLE)}) THEN length(trim({x})) > 0 "
            f"ELSE length({X.normalize_sql(lines)}) > 0 END")


def neutralize(frame: DataFrame, text: str, max_chars: int = 600, out: str = "_g") -> DataFrame:
    """Add a struct of the guarded text and the audit of what was seen and removed."""
    d, m, r = _L("(?i)" + DELIMITER), _L("(?i)" + TEMPLATE_MARKER), _L(_FLAGS + ROLE_PREFIX)
    frame = detection_variants(frame, text).withColumn("_families", F.expr(_families_sql()))
    # Most texts hold nothing that a marker or a role could start or end with.
    marked = _any_of("_spaced", ["<", "[", "###"])
    frame = frame.withColumn("_bare", F.expr(
        f"CASE WHEN {marked} THEN regexp_replace(regexp_replace(_spaced, {d}, ''), {m}, '') ELSE _spaced END"))
    frame = frame.withColumn("_lines", F.expr("CASE WHEN contains(_bare, '\\r') THEN replace(_bare, '\\r', '\\n') ELSE _bare END"))
    frame = frame.withColumn("_said", F.expr(f"CASE WHEN contains(_lines, ':') THEN regexp_replace(_lines, {r}, '') ELSE _lines END"))
    frame = frame.withColumn("_clean", F.expr(
        f"CASE WHEN octet_length(_said) = length(_said) THEN trim(regexp_replace(_said, {_L(X.LOOSE_ASCII)}, ' ')) "
        f"ELSE {X.collapse_spaces_sql('_said')} END"))
    removed = F.expr(
        f"array_compact(array(CASE WHEN rlike({text}, {_L(CONTROL)}) THEN 'control_characters' END, "
        f"CASE WHEN length(_visible) < length({text}) THEN 'invisible_characters' END, "
        f"CASE WHEN {_any_of('_visible', ['<', '[', '###'])} AND (rlike(_visible, {d}) OR rlike(_visible, {m})) THEN 'delimiter_breakout' END, "
        f"CASE WHEN contains(_lines, ':') AND rlike(_lines, {r}) THEN 'role_smuggling' END))")
    clipped = F.expr(
        f"CASE WHEN {max_chars} > 0 AND length(_clean) > {max_chars} THEN "
        f"concat(rtrim(left(_clean, {max_chars})), ' {X.ELLIPSIS}') ELSE _clean END")
    intent = intent_of(F.col("_families"))
    return frame.withColumn(out, F.struct(
        clipped.alias("text"), (F.size(intent) > 0).alias("suspicious"),
        F.col("_families").alias("families"), intent.alias("intent"), removed.alias("neutralized"),
        F.expr(f"{max_chars} > 0 AND length(_clean) > {max_chars}").alias("truncated"))
    ).drop("_visible", "_spaced", "_folded", "_squeezed", "_families", "_bare", "_lines", "_said", "_clean")


def mask_secret(value: Column | str) -> Column:
    value = F.coalesce(X.col(value), F.lit(""))
    size = F.length(value).cast("string")
    return F.when(F.length(value) <= 8, F.concat(F.lit("["), size, F.lit(" chars]"))).otherwise(
        F.concat(F.left(value, F.lit(3)), F.lit(X.ELLIPSIS + "["), size, F.lit(" chars]")))


def redact_exact(text: Column | str, secrets: list[str]) -> tuple[Column, Column]:
    """Longest secret first; returns the redacted text and the number of removals."""
    result, hits = F.coalesce(X.col(text), F.lit("")), F.lit(0).cast("long")
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        gone = F.replace(result, F.lit(secret), F.lit(""))
        hits = hits + ((F.length(result) - F.length(gone)) / len(secret)).cast("long")
        result = F.replace(result, F.lit(secret), F.lit(REDACTION_MARKER))
    return result, hits


def redact_patterns(text: Column | str) -> Column:
    text = F.regexp_replace(X.col(text), BEARER, "$1[redacted]")
    text = F.regexp_replace(text, KEY_VALUE, "$1[redacted]")
    return F.regexp_replace(text, SHORT_KEY, "[redacted]")


def is_secret_field(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_")).isin(*SECRET_FIELDS)


def strip_secret_fields(entries: Column) -> Column:
    """Drop secret-named entries of a map."""
    return F.map_filter(entries, lambda k, v: ~is_secret_field(k))


def history_role(role: Column | str) -> Column:
    return X.coerce_role(role, HISTORY_ROLES)


def role_was_privileged(role: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(X.col(role), F.lit("user")))).isin(*PRIVILEGED_ROLES)
