"""Values that are fixed by what stored codes and users' texts mean.

They are facts about postal systems and the numbering that stored keys depend on, so they are given as
they are; everything else in this package is computed from them.
"""

from __future__ import annotations

# The areas of UK postcodes. A stored code has the place of its area in this list, so an area
# can only be added at its end.
UK_AREAS = """
    AB AL B BA BB BD BF BH BL BN BR BS BT BX CA CB CF CH CM CO CR CT CV CW DA DD DE DG DH DL DN DT DY E EC EH
    EN EX FK FY G GL GU GY HA HD HG HP HR HS HU HX IG IM IP IV JE KA KT KW KY L LA LD LE LL LN LS LU M ME MK
    ML N NE NG NN NP NR NW OL OX PA PE PH PL PO PR RG RH RM S SA SE SG SK SL SM SN SO SP SR SS ST SW SY TA TD
    TF TN TQ TR TS TW UB W WA WC WD WF WN WR WS WV YO ZE GX
""".split()

# Letters that a UK postcode cannot have in its unit, and those it can have as the last letter
# of a district, after an area of one letter and of two.
UK_UNIT_LETTERS = "ABDEFGHJLNPQRSTUWXYZ"
UK_DISTRICT_LETTERS = {1: "ABCDEFGHJKPSTUW", 2: "ABEHMNPRVWXY"}

# Letters of Canadian codes, in first and in later places; characters of Eircodes, and those
# that begin one.
CA_FIRST, CA_LETTERS = "ABCEGHJKLMNPRSTVXY", "ABCEGHJKLMNPRSTVWXYZ"
IE_FIRST, IE_SYMBOLS = "ACDEFHKNPRTVWXY", "0123456789ACDEFHKNPRTVWXY"

# Format tags in stored keys.
FORMAT_TAGS = {"US": 1, "CA": 2, "FR": 3, "BR": 4, "CZ": 5, "LU": 6, "GB": 7, "IE": 8}
FIRST_PATTERN_TAG, MAX_VERSION, END_TAG = 12, 51, 63

# The compiled formats and what they are.
FORMATS = {
    "US": "United States: ZIP5, optionally ZIP+4",
    "CA": "Canada: FSA, optionally a full LDU",
    "FR": "France: five digits",
    "BR": "Brazil: five digits, optionally a suffix of three",
    "CZ": "Czech Republic: five digits, written NNN NN",
    "LU": "Luxembourg: L- and four digits",
    "GB": "United Kingdom: outcode, optionally a full postcode",
    "IE": "Ireland: routing key, optionally the unique identifier",
    "pattern": "a template or regular expression of the country's own",
}

# Countries that use a compiled format.
COMPILED_COUNTRIES = dict(
    pair.split(":")
    for pair in """
    BL:FR BR:BR CA:CA CZ:CZ FR:FR GB:GB GF:FR GG:GB GI:GB GP:FR IE:IE IM:GB JE:GB LU:LU MF:FR MQ:FR NC:FR
    PF:FR PM:FR RE:FR US:US WF:FR YT:FR
""".split()
)

# Named parts of the compiled formats' canonical text.
FORMAT_PARTS = {
    "GB": "(?<area>" + "|".join(sorted(UK_AREAS)) + r")(?<district>\d[A-Z\d]?)( (?<sector>\d)(?<walk>[A-Z]{2}))?",
    "US": r"(?<zip5>\d{5})(-(?<plus4>\d{4}))?",
    "CA": r"(?<fsa>[A-Z]\d[A-Z])( (?<ldu>\d[A-Z]\d))?",
    "IE": r"(?<routing_key>[A-Z]\d[\dW]|D6W)( (?<unique_id>[A-Z\d]{4}))?",
    "BR": r"(?<region>\d)(?<area>\d{4})(-(?<suffix>\d{3}))?",
}

# The first version of each country's pattern: a template (N digit, A letter, X either, [ ]
# optional) or a regular expression between slashes.
PATTERNS = dict(
    line.split(" ", 1)
    for line in r"""
AD /[1-7]\d{2}/
AE NNNNN[ NNNNN]
AF NNNN
AI /2640/
AL NNNN
AM NNNN
AQ /BIQQ 1ZZ/
AR /([ABCDEFGHJKLMNPQRSTUVWXYZ]\d{4}([A-Z]{3})?|\d{4})/
AS /96799(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
AT /[1-9]\d{3}/
AU NNNN
AX /22\d{3}/
AZ NNNN
BA NNNNN
BB NNNNN
BD /[1-9]\d{3}/
BE /[1-9]\d{3}/
BG /[1-9]\d{3}/
BH NNN[N]
BM AA XX
BN /[A-Z]{2}\d{4}/
BT NNNNN
BY NNNNNN
CC NNNN
CH /[1-9]\d{3}/
CL /[1-9]\d{2}-\d{4}/
CN NNNNNN
CO NNNNNN[-NNN]
CR NNNNN[-NNNN]
CU /[1-9]\d{4}/
CV NNNN
CX NNNN
CY /[1-9]\d{3}/
DE /(0[1-9]|[1-9]\d)\d{3}/
DK NNNN
DO NNNNN
DZ NNNNN
EC NNNNNN
EE /[1-9]\d{4}/
EG NNNNN[NN]
ES /(0[1-9]|[1-4]\d|5[0-2])\d{3}/
ET NNNN
FI NNNNN
FK /FIQQ 1ZZ/
FM /9694[1-4](-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
FO /[1-9]\d{2}/
GE NNNN
GH /[A-Z][A-Z0-9]\d{3,5}/
GL NNNN
GN NNN
GR /[1-8]\d{2} \d{2}/
GS /SIQQ 1ZZ/
GT NNNNN
GU /969\d{2}(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
GW NNNN
HK NNNNNN
HM NNNN
HN NNNNN
HR NNNNN
HT NNNN
HU /[1-9]\d{3}/
ID NNNNN
IL NNNNN[NN]
IN /[1-9]\d{5}/
IO /BBND 1ZZ/
IQ NNNNN
IR NNNNN[-NNNNN]
IS /[1-9]\d{2}/
IT NNNNN
JM NN
JO NNNNN
JP NNN-NNNN
KE NNNNN
KG NNNNNN
KH NNNNN[N]
KN NNNN
KR /(0[1-9]|[1-5]\d|6[0-3])\d{3}/
KW NNNNN
KY /[1-3]-\d{4}/
KZ /\d{6}|[A-Z]\d\d[A-Z]\d[A-Z]\d/
LA NNNNN
LB NNNN[ NNNN]
LC NN NNN
LI /94(8[5-9]|9[0-8])/
LK NNNNN
LR NNNN
LS NNN
LT NNNNN
LV NNNN
MA NNNNN
MC /980\d{2}/
MD NNNN
ME NNNNN
MG NNN
MH /969[67]\d(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
MK NNNN
MM NNNNN[NN]
MN NNNNN
MO NNNNNN
MP /9695[0-2](-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
MS /MSR \d{4}/
MT AAA[ NNNN]
MU /[0-9A-Z]\d{4}/
MV NNNNN
MW NNNNNN
MX /(0[1-9]|[1-9]\d)\d{3}/
MY /(0[1-9]|[1-9]\d)\d{3}/
MZ NNNN[-NN]
NA NNNNN
NE NNNN
NF NNNN
NG NNNNNN
NI /[1-9]\d{4}/
NL /[1-9]\d{3}( ([A-EGHJ-NPRTVWXZ][A-EGHJ-NPRSTVWXZ]|S[BCEGHJ-NPRTVWXZ]))?/
NO NNNN
NP NNNNN
NR AAANN
NU NNNN
NZ NNNN
OM NNN
PA NNNN[N]
PE NNNNN
PG NNN
PH NNNN
PK /[1-9]\d{4}/
PL NN-NNN
PN /PCRN 1ZZ/
PR /00[6-9]\d{2}(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
PS NNN
PT /[1-9]\d{3}(-\d{3})?/
PW /96940(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
PY NNNN[NN]
RO NNNNNN
RS NNNNN
RU NNNNNN
SA NNNNN[-NNNN]
SD NNNNN
SE /[1-9]\d{2} \d{2}/
SG NNNNNN
SH /(STHL|ASCN|TDCU) 1ZZ/
SI /[1-9]\d{3}/
SJ NNNN
SK NNN NN
SM /4789\d/
SN NNNNN
SO AA NNNNN
SV NNNN[N]
SZ /[HLMS]\d{3}/
TC /TKCA 1ZZ/
TH NNNNN
TJ NNNNNN
TM NNNNNN
TN /[1-9]\d{3}/
TR /(0[1-9]|[1-7]\d|8[01]|99)\d{3}/
TT NNNNNN
TW /\d{3}(-\d{2,3})?/
TZ NNNNN
UA /(0[1-9]|[1-9]\d)\d{3}/
UM /96898(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
UY /[1-9]\d{4}/
UZ NNNNNN
VA /00120/
VC NNNN
VE NNNN[-A]
VG NNNN
VI /008\d{2}(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
VN NNNNN[N]
WS NNNN
XK NNNNN
ZA NNNN
ZM NNNNN
""".strip().split("\n")
)

# The same patterns with names for their parts, where they have any.
NAMED_PATTERNS = dict(
    line.split(" ", 1)
    for line in r"""
AR /(?<province>[ABCDEFGHJKLMNPQRSTUVWXYZ])(?<number>\d{4})(?<face>[A-Z]{3})?|\d{4}/
AS /(?<zip5>96799)(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
BM /(?<prefix>[A-Z]{2}) (?<suffix>[0-9A-Z]{2})/
CL /(?<prefix>[1-9]\d{2})-(?<suffix>\d{4})/
CO /(?<base>\d{6})(-(?<extension>\d{3}))?/
CR /(?<base>\d{5})(-(?<extension>\d{4}))?/
ES /(?<province>0[1-9]|[1-4]\d|5[0-2])(?<local>\d{3})/
FM /(?<zip5>9694[1-4])(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
GU /(?<zip5>969\d{2})(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
IR /(?<base>\d{5})(-(?<extension>\d{5}))?/
JP /(?<prefix>\d{3})-(?<suffix>\d{4})/
KY /(?<island>[1-3])-(?<number>\d{4})/
LB /(?<base>\d{4})( (?<extension>\d{4}))?/
MH /(?<zip5>969[67]\d)(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
MP /(?<zip5>9695[0-2])(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
MT /(?<locality>[A-Z]{3})( (?<number>\d{4}))?/
MZ /(?<base>\d{4})(-(?<extension>\d{2}))?/
NL /(?<digits>[1-9]\d{3})( (?<letters>[A-EGHJ-NPRTVWXZ][A-EGHJ-NPRSTVWXZ]|S[BCEGHJ-NPRTVWXZ]))?/
PL /(?<prefix>\d{2})-(?<suffix>\d{3})/
PR /(?<zip5>00[6-9]\d{2})(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
PT /(?<base>[1-9]\d{3})(-(?<extension>\d{3}))?/
PW /(?<zip5>96940)(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
SA /(?<base>\d{5})(-(?<extension>\d{4}))?/
SO /(?<prefix>[A-Z]{2}) (?<suffix>\d{5})/
TR /(?<province>0[1-9]|[1-7]\d|8[01]|99)(?<local>\d{3})/
TW /(?<base>\d{3})(-(?<extension>\d{2,3}))?/
UM /(?<zip5>96898)(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
VE /(?<base>\d{4})(-(?<extension>[A-Z]))?/
VI /(?<zip5>008\d{2})(-(?<plus4>[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?/
""".strip().split("\n")
)

# Where other scripts' digits begin; what else is read as a hyphen, a space, a letter, or nothing.
DIGIT_ZEROS = [
    0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66,
    0x0DE6, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80, 0x1A90,
    0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0, 0xFF10,
]
HYPHENS = [*range(0x2010, 0x2016), 0x2043, 0x2212, 0xFE58, 0xFE63, 0xFF0D]
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
MALTESE = {"\u010a": "C", "\u0120": "G", "\u0126": "H", "\u017b": "Z", "\u010b": "c", "\u0121": "g", "\u0127": "h", "\u017c": "z"}
DROPPED = [*range(0x200B, 0x2010), 0x2060, 0x3012, 0xFEFF]

# Where countries' formats come from, as the world view says it. Countries that are in none of the
# lists have "GeoNames data" if they have a format, and "no postal codes" if not.
BASIS = {
    "built in": "BR CA CZ FR GB GG IE IM JE LU US".split(),
    "see note": "AE AR BM EG GI HK IL MM MO MT NL PA VN WS".split(),
    "Wikipedia": """
        AF AM AQ BA BB BH BL BN BT CU CV ET GE GH GN GR GW IQ IR JM JO KG KH KN KW KY KZ LA LB LC LR LS ME MF MG MN
        MS MU MV MZ NA NE NG NI NP OM PG PS PY SA SD SH SN SO SV SZ TJ TM TN TT TW TZ UM UZ VC VE VG XK ZM
    """.split(),
}
