"""Small grammar programs for queries and tests: (program_id, form, source, expected code)."""

from __future__ import annotations

HEADER = "اتجاهُ النصِّ: RTL"
CARRY = 'جملةٌ فعليةٌ "حملَ" فاعلُها "الجارُ" مرفوعٌ مفعولُها "الصندوقَ" منصوبٌ'
DRAW = 'جملةٌ فعليةٌ "رسمَ" فاعلُها "الأخُ" مرفوعٌ مفعولُها "الخريطةَ" منصوبٌ'
OPEN = 'جملةٌ فعليةٌ "فتحَ" فاعلُها "الحارسُ" مرفوعٌ مفعولُها "البابَ" منصوبٌ'
THEN, PLACE = 'رابطٌ "ثم" ترتيبٌ', 'جارٌّ ومجرورٌ "إلى" إضافةٌ "سوقِ" مجرورٌ "المدينةِ" مجرورٌ'
MARKET = [HEADER, 'program "market"', OPEN, THEN, CARRY, PLACE, THEN, DRAW]
REASON = [HEADER, DRAW, 'رابطٌ "لأنَّه" سببٌ', 'جملةٌ فعلُها "سافرَ" اسمٌ "بعيدًا" منصوبٌ']
TECHNICAL = [HEADER, 'verbal "نامَ" fael "الطفلُ" raf', 'connector "ثم" sequence', 'verbal "فتحَ" fael "الحارسُ" raf maful "البابَ" nasb']
DEFINE = 'دالةٌ "شحن" مُعامِلاتُها "الناقلُ" مرفوعٌ "الوزنُ" عددٌ'
MOVES = 'متنٌ "ينقلُ {الناقلُ} البضاعةَ."'
HEAVY = 'شرطٌ "الوزنُ" أكبرُ ٣٠ جزاؤُهُ "الحمولةُ ثقيلةٌ: {الوزنُ} رطلًا."'
FUNCTIONS = [HEADER, DEFINE, MOVES, HEAVY, "مُخرَجٌ نصٌّ", 'استدعاءٌ "شحن" "سالمٌ" ٤٥', 'استدعاءٌ "شحن" "هندٌ" ٣٠']

ISM = '{{"kind": "ism", "surface": "{}", "case": "{}"}}'
FIL = '{"kind": "fil", "surface": "فتحَ"}'


def _json_verbal(agent: str, patient: str) -> str:
    return f'{{"kind": "verbal", "verb": {FIL}, "fail": {ISM.format("الحارسُ", agent)}, "maful": {ISM.format("البابَ", patient)}}}'


PROGRAMS = [
    ("market", "surface", "\n".join(MARKET), None),
    ("reason", "surface", "\n".join(REASON), None),
    ("technical", "surface", "\n".join(TECHNICAL), None),
    ("json-verbal", "json", _json_verbal("Raf", "Nasb"), None),
    ("functions", "surface", "\n".join(FUNCTIONS), None),
    ("agent-case", "json", _json_verbal("Nasb", "Nasb"), "ADG1001"),
    ("patient-case", "json", _json_verbal("Raf", "Raf"), "ADG1002"),
    ("jarr-case", "json", f'{{"kind": "governance", "operator": "إلى", "operand": {ISM.format("سوقُ", "Raf")}}}', "ADG1003"),
    ("no-answer", "json", f'{{"kind": "condition", "condition": {_json_verbal("Raf", "Nasb")}, "operator": "إذا"}}', "ADG1004"),
    ("explanation", "json", f'{{"kind": "explanation", "explained": {ISM.format("سالمٌ", "Raf")}, "explanation": {ISM.format("سالمًا", "Nasb")}}}', "ADG1005"),
    ("no-question", "json", '{"kind": "question", "operator": "هل"}', "ADG1006"),
    ("no-target", "json", '{"kind": "negation", "operator": "لا"}', "ADG1007"),
    ("wrong-operator", "json", f'{{"kind": "negation", "operator": "هل", "target": {FIL}}}', "ADG1008"),
    ("misspelt", "surface", "\n".join([HEADER, CARRY.replace("مرفوعٌ", "مرفوع")]), "K001"),
    ("unknown-keyword", "surface", HEADER + '\nمبتدأٌ "سالمٌ" مرفوعٌ', "K002"),
    ("mixed", "surface", HEADER + "\nجملةٌ ism", "K003"),
    ("no-header", "surface", CARRY, "K004"),
    ("left-to-right", "surface", "اتجاهُ النصِّ: LTR\n" + CARRY, "K005"),
    ("bad-type", "surface", "\n".join([HEADER, DEFINE.replace("عددٌ", "شيءٌ")]), "F001"),
    ("no-parameter", "surface", "\n".join([HEADER, 'دالةٌ "شحن" مُعامِلاتُها "الناقلُ" مرفوعٌ', 'متنٌ "ينقلُ {الوزنُ}."', 'استدعاءٌ "شحن" "سالمٌ"']), "F002"),
    ("text-condition", "surface", "\n".join([HEADER, 'دالةٌ "شحن" مُعامِلاتُها "الناقلُ" مرفوعٌ', MOVES, 'شرطٌ "الناقلُ" أكبرُ ٠ جزاؤُهُ "لا يكون."', 'استدعاءٌ "شحن" "سالمٌ"']), "F003"),
    ("no-body", "surface", "\n".join([HEADER, DEFINE, 'استدعاءٌ "شحن" "سالمٌ" ١']), "F004"),
    ("no-function", "surface", "\n".join([*FUNCTIONS, 'استدعاءٌ "وزن"']), "F005"),
    ("arity", "surface", "\n".join([HEADER, DEFINE, MOVES, 'استدعاءٌ "شحن" "سالمٌ"']), "F006"),
    ("argument-kind", "surface", "\n".join([HEADER, DEFINE, MOVES, 'استدعاءٌ "شحن" ١ ١']), "F007"),
    ("twice", "surface", "\n".join([*FUNCTIONS, DEFINE, MOVES]), "F008"),
    ("no-call", "surface", "\n".join([HEADER, DEFINE, MOVES]), "F009"),
]
