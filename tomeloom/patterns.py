"""Patterns of the filing domain, in the syntax that Java and RE2 share unless marked.

Fixed values: what counts as a heading, a clause or a reference.  White space
is an explicit class, since engines differ on which characters ``\\s`` covers.
"""

from __future__ import annotations

import re

NBSP = "\u00a0"
SPACE = f"[ \t{NBSP}]"
ANY_SPACE = "[\\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ANY_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(ANY_SPACE, c, re.ASCII))
DASH = "—"

HEADING = f"(?im)^{SPACE}{{0,3}}Item{SPACE}+([0-9]+[A-C]?)[\\s{NBSP}.\\-{DASH}:]+([^\\n]{{0,200}})$"
INDEX_HEADER = f"(?im)^{SPACE}*(?:FORM{ANY_SPACE}+10-?K{ANY_SPACE}+)?CROSS[ \t{NBSP}\\-]+REFERENCE{SPACE}+INDEX"
INDEX_LINE = f"(?im)^{SPACE}{{0,5}}Item{SPACE}+([0-9]+[A-C]?)[\\s{NBSP}.\\-{DASH}:]+([^\\n]{{0,250}})$"
INDEX_SPLIT = f"{ANY_SPACE}{{2,}}|\t+"
INDEX_FOOTNOTE = "^\\([a-z]\\)(?:[, ]+[0-9]+)*$"


# Item number and title at the start of a line.  B is what parts
# two words; END follows titles that must end their line or have a separator.
B = f"{SPACE}+"
END = f"(?:[.:\\-{DASH}]{SPACE}+|{SPACE}*$)"
TITLES = (
    ("1", f"BUSINESS{END}"),
    ("1A", f"RISK{B}FACTORS{END}"),
    ("1B", f"UNRESOLVED{B}STAFF{B}COMMENTS{END}"),
    ("1C", f"CYBERSECURITY{END}"),
    ("2", f"PROPERTIES{END}"),
    ("3", f"LEGAL{B}PROCEEDINGS{END}"),
    ("4", f"MINE{B}SAFETY{B}DISCLOSURES{END}"),
    ("5", f"MARKET{B}FOR{B}(?:THE{B})?(?:REGISTRANT'S{B})?COMMON{B}EQUITY"),
    ("6", f"SELECTED{B}FINANCIAL{B}DATA{END}"),
    ("6", f"\\[?{SPACE}*RESERVED{SPACE}*\\]?{END}"),
    ("7", f"MANAGEMENT'?S{B}DISCUSSION{B}AND{B}ANALYSIS"),
    ("7A", f"QUANTITATIVE{B}AND{B}QUALITATIVE{B}DISCLOSURES"),
    ("8", f"FINANCIAL{B}STATEMENTS{B}AND{B}SUPPLEMENTARY{B}DATA"),
    ("9", f"CHANGES{B}IN{B}AND{B}DISAGREEMENTS{B}WITH{B}ACCOUNTANTS"),
    ("9A", f"CONTROLS{B}AND{B}PROCEDURES{END}"),
    ("9B", f"OTHER{B}INFORMATION{END}"),
    ("9C", f"DISCLOSURE{B}REGARDING{B}FOREIGN{B}JURISDICTIONS"),
    ("10", f"DIRECTORS[, ]+EXECUTIVE{B}OFFICERS"),
    ("11", f"EXECUTIVE{B}COMPENSATION{END}"),
    ("12", f"SECURITY{B}OWNERSHIP{B}OF{B}CERTAIN"),
    ("13", f"CERTAIN{B}RELATIONSHIPS{B}AND{B}RELATED"),
    ("14", f"PRINCIPAL{B}ACCOUNTANT(?:ANT)?{B}FEES"),
    ("15", f"EXHIBITS?{SPACE}*(?:AND|,){SPACE}*FINANCIAL{B}STATEMENT{B}SCHEDULES"),
    ("16", f"FORM{B}10-?K{B}SUMMARY{END}"),
)
TITLE_PATTERNS = tuple((item, f"(?im)^{SPACE}{{0,3}}{title}") for item, title in TITLES)
# No two titles share a first word, so at most one of them matches at a line start.
ANY_TITLE = f"(?im)^{SPACE}{{0,3}}(?:{'|'.join(title for _, title in TITLES)})"

BLEED = f"(?i)Item{ANY_SPACE}+([0-9]+[A-C]?)\\."
PART_HEADER = f"(?i)PART{ANY_SPACE}+(I{{1,4}}){ANY_SPACE}*Item{ANY_SPACE}+[0-9]+"
REGULATION_AB = f"item{ANY_SPACE}+11(?:0[0-9]|1[0-9]|2[0-3]){ANY_SPACE}+of{ANY_SPACE}+regulation{ANY_SPACE}+ab"

RESERVED = f"(?i)\\[{ANY_SPACE}*reserved{ANY_SPACE}*\\]"
NOT_APPLICABLE = f"(?i)^{ANY_SPACE}*(?:not{ANY_SPACE}+applicable|none)\\.?{ANY_SPACE}*$"
# Java only: a look-ahead
TITLE_BEFORE_NA = f"(?isU)^[A-Za-z][\\w{NBSP}\\s,\\-'’&/().]{{0,200}}?(?=Not{ANY_SPACE}+applicable\\.?{ANY_SPACE}*$|None\\.?{ANY_SPACE}*$)"
# Java only: a look-behind
FOOTER = (
    f"(?i)(?:(?<=[.!?]){ANY_SPACE}*[A-Z][\\w.®]*(?:{ANY_SPACE}+[\\w.®]+){{0,2}}{ANY_SPACE}*\\|{ANY_SPACE}*[0-9]{{4}}{ANY_SPACE}+Form{ANY_SPACE}+10-K{ANY_SPACE}*\\|{ANY_SPACE}*[0-9]+{ANY_SPACE}*(?:PART{ANY_SPACE}+[IVX]+)?"
    f"|{ANY_SPACE}*PART{ANY_SPACE}+[IVX]+){ANY_SPACE}*$"
)
ITEM_PREFIX = f"(?i)^{ANY_SPACE}*item{ANY_SPACE}+[0-9]+[A-C]?\\.?{ANY_SPACE}*"
BY_REFERENCE = (
    f"(?is)\\b(?:information{ANY_SPACE}+(?:required{ANY_SPACE}+(?:by{ANY_SPACE}+this{ANY_SPACE}+item{ANY_SPACE}+)?|called{ANY_SPACE}+for{ANY_SPACE}+by{ANY_SPACE}+this{ANY_SPACE}+item))\\b"
    f"[^.]{{0,300}}?\\b(?:incorporated{ANY_SPACE}+(?:herein{ANY_SPACE}+)?by{ANY_SPACE}+reference|will{ANY_SPACE}+be{ANY_SPACE}+(?:included|set{ANY_SPACE}+forth|contained|presented){ANY_SPACE}+in{ANY_SPACE}+the{ANY_SPACE}+(?:[0-9]{{4}}{ANY_SPACE}+)?proxy{ANY_SPACE}+statement)\\b"
)
WEBSITE_NOT = f"(?i)websites?{ANY_SPACE}+(?:referenced[^.]{{0,80}}|on{ANY_SPACE}+which[^.]{{0,80}})not{ANY_SPACE}+incorporated{ANY_SPACE}+by{ANY_SPACE}+reference"
SEE_PROXY = f"(?im)^{ANY_SPACE}*see{ANY_SPACE}+(?:our{ANY_SPACE}+|the{ANY_SPACE}+)?[0-9\\s{NBSP}]*proxy{ANY_SPACE}+statement"
REMAINING = f"(?i)\\b(?:remaining|additional|other){ANY_SPACE}+information{ANY_SPACE}+(?:required{ANY_SPACE}+|called{ANY_SPACE}+for{ANY_SPACE}+)?by{ANY_SPACE}+this{ANY_SPACE}+item"
# Java only: a counted repeat above 1,000
COVER = f"(?is)DOCUMENTS{ANY_SPACE}+INCORPORATED{ANY_SPACE}+BY{ANY_SPACE}+REFERENCE\\b.{{0,2000}}?(19[89][0-9]|20[0-9]{{2}}){ANY_SPACE}+(?:annual{ANY_SPACE}+meeting|proxy{ANY_SPACE}+statement|definitive{ANY_SPACE}+proxy)"

SECTION_KEY = "(?i)^part_(i|ii|iii|iv)_item_([0-9]+[a-z]?)$"
ITEM_LABEL = f"(?i)^Item{ANY_SPACE}+([0-9]+[A-C]?)$"
HINT_BY_REFERENCE = f"(?i)\\b(?:incorporated{ANY_SPACE}+(?:herein{ANY_SPACE}+)?by{ANY_SPACE}+reference|by{ANY_SPACE}+reference{ANY_SPACE}+(?:to|herein))\\b"
HINT_SEE_ITEM = f"(?i)\\bsee{ANY_SPACE}+Item{ANY_SPACE}+[0-9]+[A-C]?\\b"
CIK = "^[0-9]{1,10}\\n?$"
ACCESSION = "^[0-9]{10}-[0-9]{2}-[0-9]{6}\\n?$"
STRIP = f"^{ANY_SPACE}+|{ANY_SPACE}+$"
