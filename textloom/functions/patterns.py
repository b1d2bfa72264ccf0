"""Patterns of the annotators, in Java's dialect.

``WS`` is the Unicode white space that ``\\s`` must mean here, ``EDGE_BEFORE`` and
``EDGE_AFTER`` are Unicode word borders.  Quantifiers are possessive wherever nothing
that follows could want a shorter match, which keeps the engine's stack flat on long runs.

A match is tried once in a run, so that a run without one costs its length, not its square:
a domain starts where its run of labels starts, a command's line where the white space before
it starts.  ``*_LEAD`` are what such a pattern takes in before what is meant.
"""

from __future__ import annotations

WS = r"\t\n\x0B\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
BREAKS = rf"{WS}<>\"'`()\[\]{{}}"  # what ends a url or a path

# What each kind of annotation looks like.
URL = rf"(?iu)https?://[^{BREAKS}]+"
DOMAIN_LEAD = r"_[A-Za-z0-9-]*+\."  # a label after ``_`` is none of a domain, but the next may be
DOMAIN = (
    rf"(?:(?<![A-Za-z0-9_-])(?<![A-Za-z0-9-]\.)|{DOMAIN_LEAD})"
    r"[A-Za-z0-9-]++(?:(?:\.[0-9-][A-Za-z0-9-]*+)*+\.[A-Za-z][A-Za-z0-9-]*+(?![A-Za-z0-9_-]))++"
)
IP_ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
FILESYSTEM_PATH = rf"(?<![A-Za-z0-9_:/])(?:~[\\/]|[A-Za-z]:\\|\.{{1,2}}/|/)[^{BREAKS}]+"
ENVIRONMENT_VARIABLE = r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))"
CODE_FENCE = r"(?s)```[^\r\n]*\r?\n.*?```"
SHELL_LEAD = rf"(?:\G|(?<=[^{WS}]))[{WS}&&[^\n]]*+\n"
SHELL_COMMAND = (
    rf"(?:\A|{SHELL_LEAD})[{WS}]*+(?:[$#][{WS}]*+)?+"
    r"(?:curl|wget|python3?|node|bash|sh|zsh|pwsh|powershell|rm|cp|mv|cat|grep|sed|awk|chmod|chown|git)"
    rf"{EDGE_AFTER}[^\r\n]*"
)
BASE64_CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{8,}+={0,2}+(?![A-Za-z0-9+/=_-])"
HEX_CANDIDATE = r"(?<![A-Fa-f0-9])(?:[A-Fa-f0-9]{2}){4,}+(?![A-Fa-f0-9])"
URL_ENCODED_CANDIDATE = r"(?<!%)(?:%[0-9A-Fa-f]{2}){4,}+"
LONG_TOKEN = r"[A-Za-z0-9+/=_-]{32,}+"
LABEL = r"(?:include|file|path|reference)[ \t]*+:[ \t]*+"
LABELLED_FILE = rf"(?iu){EDGE_BEFORE}{LABEL}[^{WS}#]+"
FILE_NAME = (
    r"(?iu)(?<![A-Za-z0-9_.-])[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\."
    r"(?:md|txt|json|yaml|yml|toml|ini|cfg|conf|lock|lockb|py|js|ts|tsx|jsx|sh|ps1)"
    r"(?![A-Za-z0-9_-]|\.[A-Za-z0-9])"
)
FILE_ACTION_BEFORE = (
    rf"(?iu){EDGE_BEFORE}(?:append|create|delete|edit|inspect|load|modify|open|read|replace|save|update|write)"
    r"(?:[ \t]+(?:a|an|the))?[ \t]*\z"
)
FILE_LABEL_BEFORE = rf"(?iu){EDGE_BEFORE}(?:include|file|path|reference)[ \t]*:[ \t]*\z"
MIN_ENTROPY = 3.5
