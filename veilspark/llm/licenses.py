"""License scan: ordered signature rules over the words of a text, in DataFrame functions alone.

A text is reduced to its words, parted by single blanks. Rules are regular expressions
with a keyword each; a rule runs only where its keyword stands, and texts without any
license word are passed over by one expression. A detection is dropped if one of the
same or a higher priority covers its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.arrays import let, running
from veilspark.llm.common import lower_az, table

#: Whatever parts words: ASCII but letters and digits. Upper case is part of a word before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """A signature: the words it looks for, a keyword that stands wherever it matches, and what it says."""

    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float
    base: bool = False


# Phrases that are always reported.
BASE_RULES = (
    Rule("cc-by", "cc by", "cc by", 1, 0.5, True),
    Rule("gpl", "general public license", "general public license", 1, 0.6, True),
    Rule("reserved", "all rights reserved", "all rights reserved", 1, 0.4, True),
)

# Fixed values: ``label | keyword | names``, names as patterns over words ("2.0" is "2 0").
_FAMILIES = """
mit                | mit          | mit(?: x11)?
mit                | expat        | expat(?: x11)?
apache-1.1         | apache       | apache(?: software)?(?: version| v)? ?1 1
apache-2.0         | apache       | apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?
apache             | apache       | apache(?: software)?
bsd-2-clause       | bsd          | freebsd(?: bsd)?
bsd-2-clause       | simplified   | simplified(?: bsd)?
bsd-2-clause       | 2 clause     | 2 clause(?: bsd)?
bsd-2-clause       | two clause   | two clause(?: bsd)?
bsd-2-clause       | bsd          | bsd 2 clause
bsd-3-clause       | bsd          | (?:new|revised|modified|3 clause|three clause) bsd
bsd-3-clause       | bsd          | bsd 3 clause
bsd-4-clause       | bsd          | (?:original|4 clause|four clause) bsd
bsd-4-clause       | bsd          | bsd 4 clause
0bsd               | bsd          | (?:0bsd|zero clause bsd|bsd zero clause)
bsd                | bsd          | bsd(?: style)?
isc                | isc          | isc
zlib               | zlib         | zlib(?: libpng)?
x11                | x11          | x11
unlicense          | unlicense    | unlicense
wtfpl              | you want to public | do what the fuck you want to public
wtfpl              | wtfpl        | wtfpl
cc0-1.0            | cc0          | cc0(?: 1 0)?(?: universal)?
cc0-1.0            | zero         | creative commons zero(?: v?1 0)?
bsl-1.0            | boost        | boost(?: software)?(?: license)?(?: version)?(?: 1 0)?
busl-1.1           | business     | business source(?: license)?(?: 1 1)?
sspl-1.0           | server side  | server side public(?: license)?(?: version 1)?
elastic-2.0        | elastic      | elastic(?: license)?(?: version)? ?(?:v?2(?: 0)?)?
artistic-1.0       | artistic     | artistic(?: license)?(?: version)? v?1(?: 0)?
artistic-2.0       | artistic     | artistic(?: license)?(?: version)? v?2(?: 0)?
afl-3.0            | academic     | academic free(?: license)?(?: version| v)?(?: ?3 0)?
osl-3.0            | open software| open software(?: license)?(?: version| v)?(?: ?3 0)?
eupl-1.1           | european     | european union public(?: licen[cs]e)?(?: version| v)? ?1 1
eupl-1.2           | european     | european union public(?: licen[cs]e)?(?: version| v)?(?: ?1 2)?
eupl               | eupl         | eupl(?: v?1 [12])?
ms-pl              | microsoft    | microsoft public
ms-rl              | microsoft    | microsoft reciprocal
postgresql         | postgresql   | postgresql
python-2.0         | python       | python(?: software foundation)?(?: license)?(?: version 2)?
ruby               | ruby         | ruby
php-3.01           | php          | php(?: license)?(?: version)?(?: 3 01)?
openssl            | openssl      | openssl
ofl-1.1            | open font    | sil open font(?: license)?(?: version)?(?: 1 1)?
ofl-1.1            | ofl          | ofl(?: 1 1)?
odbl-1.0           | open database| open database(?: license)?(?: v?1 0)?
odbl-1.0           | odbl         | odbl(?: 1 0)?
odc-by-1.0         | open data    | open data commons attribution(?: license)?(?: v?1 0)?
pddl-1.0           | public domain dedication | public domain dedication(?: and license)?
cecill-2.1         | cecill       | cecill(?: v?2(?: 1)?)?
upl-1.0            | permissive   | universal permissive(?: license)?(?: v?1 0)?
ncsa               | ncsa         | (?:university of illinois )?ncsa(?: open source)?
ecl-2.0            | educational  | educational community(?: license)?(?: version)?(?: 2 0)?
lppl-1.3c          | latex        | latex project public(?: license)?(?: version)?(?: 1 3c?)?
qpl-1.0            | q public     | q public(?: license)?(?: version)?(?: 1 0)?
zpl-2.1            | zope         | zope public(?: license)?(?: version)?(?: 2 1)?
w3c                | w3c          | w3c(?: software)?(?: notice and)?
json               | json         | json
sleepycat          | sleepycat    | sleepycat
vim                | vim          | vim
mpl                | mozilla      | mozilla public
epl                | eclipse      | eclipse public
cpl-1.0            | common public| common public(?: license)?(?: version| v)?(?: ?1 0)?
cddl               | common development | common development and distribution
gpl                | gpl          | gpl
lgpl               | lgpl         | lgpl
agpl               | agpl         | agpl
gpl                | gnu general  | gnu general public
lgpl               | gnu l        | gnu (?:lesser|library) general public
agpl               | gnu affero   | gnu affero general public
gfdl               | free documentation | gnu free documentation
"""

#: Licenses that come in versions: label, short name, long name, versions. Each version gives names of its own.
_VERSIONED = (
    ("gpl", "gpl", "(?:gnu )?general public", ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", "(?:gnu )?(?:lesser|library) general public", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl", "(?:gnu )?affero general public", ("1.0", "3.0")),
    ("gfdl", "gfdl", "(?:gnu )?free documentation", ("1.1", "1.2", "1.3")),
    ("mpl", "mpl", "mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", "epl", "eclipse public", ("1.0", "2.0")),
    ("cddl", "cddl", "common development and distribution", ("1.0", "1.1")),
)
_CC_PARTS = (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s(?: works)?"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

_UNDER = (
    r"(?:licensed|relicensed|released|distributed|redistributed|available|provided|published|covered|used|shared|offered)"
    r" (?:to you )?under(?: the)?(?: terms(?: and conditions)?(?: of)?(?: the)?)? (?:an? )?"
)
# Statements that name no license of the tables.
_STATEMENTS = (
    Rule("public-domain", "(?:in|into|to|dedicated to) the public domain", "public domain", 2, 0.7),
    Rule("copyright", r"copyright(?: c)?(?: by)? (?:19|20)\d\d(?: (?:19|20)\d\d)*", "copyright", 1, 0.3),
    Rule("copyright", "all copyrights? (?:are )?reserved", "copyright", 1, 0.3),
    Rule("reserved", "all rights (?:are )?reserved by", "rights", 2, 0.5),
    Rule("some-rights", "some rights reserved", "some rights reserved", 2, 0.5),
    Rule("no-warranty", "without (?:any )?warrant(?:y|ies) (?:of any kind|or conditions of any kind)", "warrant", 1, 0.3),
    Rule("permissive", "permission is hereby granted free of charge", "hereby granted", 2, 0.8),
    Rule("permissive", "permission to use copy modify and or distribute this software", "permission to use", 2, 0.8),
    Rule("permissive", "redistribution and use in source and binary forms", "redistribution", 2, 0.8),
    Rule("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary", 2, 0.6),
    Rule("proprietary", "unauthorized (?:copying|use|reproduction|distribution) (?:of|is)", "unauthorized", 1, 0.5),
    Rule("non-commercial", "for (?:non commercial|noncommercial|personal) use only", "use only", 1, 0.4),
)


def _version(version: str) -> str:
    """A version over words; the last 0 may be left out."""
    major, minor = version.split(".")
    return f"(?:version |v ?|ver )?v?{major} {minor}" if minor != "0" else f"(?:version |v ?|ver )?v?{major}(?: 0)?"


def _names() -> list[tuple[str, str, str]]:
    """``label, keyword, name`` of every license."""
    found = []
    for line in _FAMILIES.strip().splitlines():
        label, keyword, name = (part.strip() for part in line.split("|", 2))
        found.append((label, keyword, name))
    for label, short, long, versions in _VERSIONED:
        keyword = re.sub(r"\(.*?\)\??", "", long).strip()
        for version in versions:
            found.append((f"{label}-{version}", keyword, f"{long} licen[cs]e {_version(version)}(?: or (?:any )?later(?: version)?)?"))
            found.append((f"{label}-{version}", short, f"{short} ?{_version(version)}(?: or later| only)?"))
    for parts in _CC_PARTS:
        long = " ".join(_CC_WORDS[p] for p in parts)
        for version in ("", *_CC_VERSIONS):
            label = "-".join(["cc", *parts, *([version] if version else [])])
            end = " (?:v)?" + version.replace(".", " ") if version else ""
            found.append((label, "cc by", "cc " + " ".join(parts) + end))
            tail = f"(?: licen[cs]e)?{end}" if not version else f"(?: \\w+)?(?: licen[cs]e)?{end}"
            found.append((label, "creative commons", f"creative commons {long}{tail}"))
    return found


def _bare(keyword: str, name: str) -> str:
    """The name by itself: with the word license somewhere, unless the name can't be anything else."""
    if keyword in ("cc by", "creative commons") or re.match(r"[al]?gpl \?|gfdl \?|mpl \?|epl \?|cddl \?", name):
        return name
    required = re.sub(r"\(\?: licen(?:\[cs\]|s)e\)\?", " licen[cs]e", name)
    if required == name and " licen[cs]e" in name:
        return name
    followed = f"(?:{name}) (?:public )?licen[cs]e"
    return followed if required == name else f"(?:{followed}|{required})"


def license_rules() -> list[Rule]:
    """All rules in order: base phrases, statements, and for every license its mark, its notice and its bare name."""
    rules = [*BASE_RULES, *_STATEMENTS]
    marked = set()
    for label, keyword, name in _names():
        rules.append(Rule(label, f"{_UNDER}(?:{name})(?: (?:public )?licen[cs]e)?", keyword, 3, 0.9))
        rules.append(Rule(label, _bare(keyword, name), keyword, 2, 0.7))
        if label not in marked and re.search(r"\d|^(mit|isc|zlib|x11|unlicense|wtfpl|ncsa|json|ruby|vim|postgresql)$", label):
            marked.add(label)
            words = re.sub(r"[^0-9a-z]+", " ", label)
            rules.append(Rule(label, f"spdx license identifiers? {words}(?: only| or later)?", "spdx", 4, 1.0))
    return rules


RULES = tuple(license_rules())
#: Stands in every text that any rule matches; A-Z match either case, nothing else does.
_GATE = (
    r"(?i)licen[cs]e|reserved|copyright|spdx|public|warrant|permission|redistribution"
    rf"|(?:ed|able){GAP}(?:to{GAP}you{GAP})?under|proprietary|confidential|unauthorized|use{GAP}only|cc{GAP}by|creative{GAP}commons|gpl|mpl|epl|cddl|gfdl"
)


def _rule_array(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("rule"),
            F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
            F.lit(r.keyword).alias("keyword"),
            F.lit(r.label).alias("label"),
            F.lit(r.priority).alias("priority"),
            F.lit(r.confidence).alias("confidence"),
            F.lit(r.base).alias("base"),
        )
        for i, r in enumerate(rules)
    ])


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _places(line: Column, rule: Column) -> Column:
    """Detections of one rule: the matches, placed by the blanks in the gaps and matches before them."""

    def placed(hits: Column, gaps: Column) -> Column:
        # Blanks up to the end of each match, less those in the match, are its first word plus one.
        blanks = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: _blanks(gap) + _blanks(hit))
        return let(
            running(blanks, lambda a, b: a + b),
            lambda upto: F.zip_with(
                upto,
                hits,
                lambda end, hit: F.struct(
                    (end - _blanks(hit) - 1).cast("long").alias("start"),
                    (-end).cast("long").alias("minus_end"),
                    (-rule["priority"]).alias("minus_priority"),
                    rule["rule"].alias("rule"),
                    rule["label"].alias("label"),
                    rule["confidence"].alias("confidence"),
                    rule["base"].alias("base"),
                ),
            ),
        )

    hits = F.regexp_extract_all(line, rule["pattern"], F.lit(0))
    gaps = F.split(line, rule["pattern"], F.lit(-1))
    return let(hits, lambda h: let(gaps, lambda g: placed(h, g)))


def _uncovered(found: Column, top: int) -> Column:
    """Detections, sorted by place, that none before them of at least their priority reaches across."""

    def reaches(all_found: Column) -> Column:
        levels = [running(F.transform(all_found, ends_at(p)), F.greatest) for p in range(1, top + 1)]
        return let(F.array(*levels), lambda reach: F.filter(all_found, lambda d, i: kept(d, i, reach)))

    def ends_at(priority: int):
        """Where a detection of at least this priority ends."""
        return lambda d: F.when(d["minus_priority"] <= -priority, -d["minus_end"]).otherwise(F.lit(-1).cast("long"))

    def kept(d: Column, i: Column, reach: Column) -> Column:
        return (i == 0) | (F.element_at(F.element_at(reach, -d["minus_priority"]), F.greatest(i, F.lit(1))) < -d["minus_end"])

    return let(F.array_sort(found), reaches)


def detections(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``all`` and ``kept`` detections of a text: ``start`` and ``minus_end`` in words, ``rule, label, confidence, base``."""
    words = F.regexp_replace(lower_az(text), GAP, " ")
    line = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])
    top = max(r.priority for r in rules)

    def scan(padded: Column) -> Column:
        there = F.filter(keywords, lambda k: F.contains(padded, k))
        return let(there, lambda own: F.flatten(F.transform(chosen(own), lambda rule: _places(padded, rule))))

    def chosen(own: Column) -> Column:
        return F.filter(_rule_array(rules), lambda r: F.array_contains(own, r["keyword"]))

    return let(let(line, scan), lambda found: F.struct(found.alias("all"), _uncovered(found, top).alias("kept")))


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of ``docs`` (``doc_id, text``), in one pass without a shuffle.

    ``n_words``; ``n_base, first_word, last_word, base_labels`` of the base phrases, covered
    or not; ``labels`` of these and of the detections that stay; ``score``, the highest
    confidence of what stays, 0 without any; ``spans``, what stays: ``label, rule, start,
    end`` in words, the end not included. Null texts read as empty: no words, no labels
    (empty strings) and null places. Repeated rows and null ids stay, other columns are not
    carried.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    nothing = F.lit(None)
    slim = docs.select(
        "doc_id",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(text.rlike(_GATE), detections(text, rules)).otherwise(nothing).alias("found"),
    )
    base = F.filter("found.all", lambda d: d["base"])
    slim = slim.select("doc_id", "n_words", "found", base.alias("base"))
    starts = F.transform("base", lambda d: d["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda d: d["label"]), F.transform("found.kept", lambda d: d["label"]))))
    confidence = F.array_max(F.transform("found.kept", lambda d: d["confidence"]))
    span = F.transform(
        "found.kept",
        lambda d: F.struct(d["label"].alias("label"), d["rule"].alias("rule"), d["start"].alias("start"), (-d["minus_end"]).alias("end")),
    )
    return slim.select(
        "doc_id",
        "n_words",
        F.greatest(F.lit(0), F.coalesce(F.size("base"), F.lit(0))).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.coalesce(confidence, F.lit(0.0)).alias("score"),
        span.alias("spans"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
