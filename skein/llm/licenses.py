"""License scans by ordered signature rules: a keyword opens a text to its rules; overlaps are settled by containment.

Texts are brought to words of lower-case letters and digits, one space between, so a rule's spaces are word
boundaries. Hundreds of rules come from the families below: each has a label, a keyword, and regexes in order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, documents

#: What separates words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base: label by phrase.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_V = r"(?: version| v)?"
#: label: (keyword, regexes in order of priority). ``#`` stands for an optional "version".
RULES = {
    "agpl-3.0": ("affero", [r"gnu affero general public license#(?: 3| v3)(?: 0)?(?: only| or later)?", r"affero gpl#(?: 3| v3)", r"agpl(?: v)? ?3(?: 0)?(?: only| or later)?"]),
    "agpl": ("affero", [r"gnu affero general public licen[sc]e", r"affero general public licen[sc]e", r"affero gpl"]),
    "agpl-short": ("agpl", [r"agplv3", r"agpl 3(?: 0)?(?: only| or later)?", r"licensed under (?:the )?agpl"]),
    "gpl-3.0": ("general", [r"gnu general public licen[sc]e# ?(?:3|v3)(?: 0)?", r"gnu general public licen[sc]e as published by the free software foundation either version 3", r"version 3 of the gnu general public licen[sc]e"]),
    "gpl-2.0": ("general", [r"gnu general public licen[sc]e# ?(?:2|v2)(?: 0)?", r"gnu general public licen[sc]e as published by the free software foundation either version 2", r"version 2 of the gnu general public licen[sc]e"]),
    "gpl-1.0": ("general", [r"gnu general public licen[sc]e# ?(?:1|v1)(?: 0)?", r"version 1 of the gnu general public licen[sc]e"]),
    "gpl": ("general", [r"gnu general public licen[sc]e", r"gnu gpl", r"terms of the general public licen[sc]e"]),
    "gpl-short": ("gpl", [r"gplv[123]", r"gpl [123](?: 0)?(?: only| or later)?", r"(?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl", r"spdx license identifier gpl"]),
    "lgpl-3.0": ("lesser", [r"gnu lesser general public licen[sc]e# ?(?:3|v3)(?: 0)?", r"version 3 of the gnu lesser general public licen[sc]e"]),
    "lgpl-2.1": ("lesser", [r"gnu lesser general public licen[sc]e# ?2 1", r"version 2 1 of the gnu lesser general public licen[sc]e"]),
    "lgpl": ("lesser", [r"gnu lesser general public licen[sc]e", r"lesser general public licen[sc]e", r"lesser gpl"]),
    "lgpl-2.0": ("library", [r"gnu library general public licen[sc]e(?:# ?2(?: 0)?)?", r"library general public licen[sc]e"]),
    "lgpl-short": ("lgpl", [r"lgplv[23]", r"lgpl [23](?: [01])?(?: only| or later)?", r"(?:licensed|released|distributed) under (?:the )?(?:gnu )?lgpl"]),
    "gfdl": ("documentation", [r"gnu free documentation licen[sc]e(?:# ?1 [123])?", r"free documentation licen[sc]e"]),
    "apache-2.0": ("apache", [r"apache licen[sc]e# ?2(?: 0)?", r"apache software licen[sc]e# ?2(?: 0)?", r"apache 2(?: 0)? licen[sc]e", r"licensed under the apache licen[sc]e", r"spdx license identifier apache 2 0", r"www apache org licenses license 2 0"]),
    "apache-1.1": ("apache", [r"apache (?:software )?licen[sc]e# ?1 1", r"spdx license identifier apache 1 1"]),
    "apache-1.0": ("apache", [r"apache (?:software )?licen[sc]e# ?1 0", r"spdx license identifier apache 1 0"]),
    "apache": ("apache", [r"apache (?:software )?licen[sc]e", r"apache style licen[sc]e", r"under (?:the )?apache"]),
    "mit": ("mit", [r"(?:the )?mit licen[sc]e(?: mit)?", r"released under the mit licen[sc]e", r"mit style licen[sc]e", r"spdx license identifier mit", r"licensed under (?:the )?mit", r"mit x11 licen[sc]e"]),
    "mit-text": ("permission", [r"permission is hereby granted free of charge to any person obtaining a copy", r"permission to use copy modify and or distribute this software for any purpose"]),
    "mit-0": ("attribution", [r"mit no attribution", r"mit 0 no attribution"]),
    "x11": ("x11", [r"x11 licen[sc]e", r"x11 mit", r"spdx license identifier x11"]),
    "isc": ("isc", [r"isc licen[sc]e", r"spdx license identifier isc", r"licensed under (?:the )?isc"]),
    "bsd-4-clause": ("bsd", [r"bsd 4 clause(?: licen[sc]e)?", r"four clause bsd", r"original bsd licen[sc]e"]),
    "bsd-3-clause": ("bsd", [r"bsd 3 clause(?: licen[sc]e)?", r"three clause bsd", r"new bsd licen[sc]e", r"modified bsd licen[sc]e", r"revised bsd licen[sc]e"]),
    "bsd-2-clause": ("bsd", [r"bsd 2 clause(?: licen[sc]e)?", r"two clause bsd", r"simplified bsd licen[sc]e", r"freebsd licen[sc]e"]),
    "bsd-1-clause": ("bsd", [r"bsd 1 clause(?: licen[sc]e)?", r"one clause bsd"]),
    "0bsd": ("0bsd", [r"0bsd", r"zero clause bsd", r"free public licen[sc]e 1 0 0"]),
    "bsd": ("bsd", [r"bsd licen[sc]e", r"bsd style licen[sc]e", r"licensed under (?:the )?bsd", r"berkeley software distribution"]),
    "bsd-text": ("redistribution", [r"redistribution and use in source and binary forms with or without modification", r"redistributions of source code must retain the above copyright"]),
    "mpl-2.0": ("mozilla", [r"mozilla public licen[sc]e# ?2(?: 0)?", r"source code form is subject to the terms of the mozilla public licen[sc]e"]),
    "mpl-1.1": ("mozilla", [r"mozilla public licen[sc]e# ?1 1"]),
    "mpl-1.0": ("mozilla", [r"mozilla public licen[sc]e# ?1 0"]),
    "mpl": ("mozilla", [r"mozilla public licen[sc]e", r"mozilla licen[sc]e"]),
    "mpl-short": ("mpl", [r"mpl 2 0", r"mpl 1 1", r"mplv2", r"licensed under (?:the )?mpl"]),
    "epl-2.0": ("eclipse", [r"eclipse public licen[sc]e# ?(?:v )?2(?: 0)?"]),
    "epl-1.0": ("eclipse", [r"eclipse public licen[sc]e# ?(?:v )?1(?: 0)?"]),
    "epl": ("eclipse", [r"eclipse public licen[sc]e", r"eclipse distribution licen[sc]e"]),
    "epl-short": ("epl", [r"epl 2 0", r"epl 1 0", r"licensed under (?:the )?epl"]),
    "cddl-1.1": ("common", [r"common development and distribution licen[sc]e# ?1 1"]),
    "cddl-1.0": ("common", [r"common development and distribution licen[sc]e(?:# ?1 0)?"]),
    "cddl-short": ("cddl", [r"cddl 1 [01]", r"licensed under (?:the )?cddl"]),
    "cpl-1.0": ("common", [r"common public licen[sc]e(?:# ?1 0)?"]),
    "cpal-1.0": ("common", [r"common public attribution licen[sc]e(?:# ?1 0)?"]),
    "ipl-1.0": ("ibm", [r"ibm public licen[sc]e(?:# ?1 0)?"]),
    "cc0-1.0": ("cc0", [r"cc0 1 0(?: universal)?", r"cc0 public domain dedication", r"cc0"]),
    "cc-by-nc-nd": ("cc", [r"cc by nc nd(?: [1234] 0)?"]),
    "cc-by-nc-sa": ("cc", [r"cc by nc sa(?: [1234] 0)?"]),
    "cc-by-nc": ("cc", [r"cc by nc(?: [1234] 0)?"]),
    "cc-by-nd": ("cc", [r"cc by nd(?: [1234] 0)?"]),
    "cc-by-sa": ("cc", [r"cc by sa(?: [1234] 0)?"]),
    "cc-by": ("cc", [r"cc by(?: [1234] 0)?"]),
    "cc-by-nc-nd-long": ("commons", [r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"]),
    "cc-by-nc-sa-long": ("commons", [r"creative commons attribution non ?commercial share ?alike"]),
    "cc-by-nc-long": ("commons", [r"creative commons attribution non ?commercial"]),
    "cc-by-sa-long": ("commons", [r"creative commons attribution share ?alike"]),
    "cc-by-nd-long": ("commons", [r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?"]),
    "cc-by-long": ("commons", [r"creative commons attribution(?: [1234] 0)?", r"creativecommons org licenses by"]),
    "cc0-long": ("commons", [r"creative commons zero", r"creative commons public domain"]),
    "cc": ("commons", [r"creative commons licen[sc]e", r"creative commons"]),
    "unlicense": ("unlicense", [r"the unlicense", r"unlicense org", r"unlicense"]),
    "unlicense-text": ("unencumbered", [r"free and unencumbered software released into the public domain"]),
    "public-domain": ("domain", [r"(?:released|placed|dedicated) (?:in|into|to) the public domain", r"in the public domain", r"public domain dedication"]),
    "wtfpl": ("wtfpl", [r"wtfpl(?: 2)?"]),
    "zlib": ("zlib", [r"zlib licen[sc]e", r"zlib libpng licen[sc]e", r"zlib acknowledg(?:e)?ment"]),
    "zlib-text": ("express", [r"this software is provided as is without any express or implied warranty"]),
    "libpng": ("libpng", [r"libpng licen[sc]e(?: 2 0)?"]),
    "bsl-1.0": ("boost", [r"boost software licen[sc]e(?:# ?1 0)?", r"boost licen[sc]e"]),
    "busl-1.1": ("business", [r"business source licen[sc]e(?:# ?1 1)?"]),
    "sspl-1.0": ("server", [r"server side public licen[sc]e(?:# ?1)?"]),
    "elastic-2.0": ("elastic", [r"elastic licen[sc]e(?:# ?2(?: 0)?)?"]),
    "artistic-2.0": ("artistic", [r"artistic licen[sc]e# ?2(?: 0)?"]),
    "artistic-1.0": ("artistic", [r"artistic licen[sc]e# ?1 0(?: perl)?"]),
    "artistic": ("artistic", [r"artistic licen[sc]e", r"clarified artistic licen[sc]e"]),
    "perl": ("perl", [r"same terms as perl(?: itself)?", r"under the same terms as the perl"]),
    "psf-2.0": ("python", [r"python software foundation licen[sc]e(?:# ?2)?", r"psf licen[sc]e", r"python licen[sc]e(?: 2 0)?"]),
    "cnri-python": ("cnri", [r"cnri python licen[sc]e", r"cnri open source licen[sc]e"]),
    "ruby": ("ruby", [r"ruby licen[sc]e", r"same terms as ruby", r"licensed under ruby s"]),
    "php-3.01": ("php", [r"php licen[sc]e# ?3 01", r"php licen[sc]e(?:# ?3 0)?"]),
    "zpl-2.1": ("zope", [r"zope public licen[sc]e(?:# ?2 [01])?"]),
    "ofl-1.1": ("sil", [r"sil open font licen[sc]e(?:# ?1 [01])?", r"sil ofl"]),
    "ofl": ("font", [r"open font licen[sc]e(?:# ?1 [01])?"]),
    "ms-pl": ("microsoft", [r"microsoft public licen[sc]e", r"ms pl"]),
    "ms-rl": ("microsoft", [r"microsoft reciprocal licen[sc]e", r"ms rl"]),
    "osl-3.0": ("open", [r"open software licen[sc]e(?:# ?(?:v )?3 0)?", r"open software licen[sc]e# ?2 [01]"]),
    "afl-3.0": ("academic", [r"academic free licen[sc]e(?:# ?3 0)?", r"academic free licen[sc]e# ?2 [01]"]),
    "ecl-2.0": ("educational", [r"educational community licen[sc]e(?:# ?[12](?: 0)?)?"]),
    "eupl-1.2": ("european", [r"european union public licen[sc]e# ?1 2", r"european union public licen[sc]e# ?1 1", r"european union public licen[sc]e"]),
    "eupl-short": ("eupl", [r"eupl(?: 1 [012])?"]),
    "ncsa": ("illinois", [r"university of illinois ncsa open source licen[sc]e", r"illinois open source licen[sc]e"]),
    "postgresql": ("postgresql", [r"postgresql licen[sc]e"]),
    "vim": ("vim", [r"vim licen[sc]e", r"same terms as vim"]),
    "json": ("evil", [r"the software shall be used for good not evil"]),
    "openssl": ("openssl", [r"openssl licen[sc]e", r"for use in the openssl toolkit"]),
    "ssleay": ("ssleay", [r"original ssleay licen[sc]e", r"ssleay licen[sc]e"]),
    "curl": ("curl", [r"curl licen[sc]e", r"spdx license identifier curl"]),
    "w3c": ("w3c", [r"w3c software (?:notice and )?licen[sc]e", r"w3c document licen[sc]e"]),
    "unicode": ("unicode", [r"unicode licen[sc]e(?: v3)?", r"unicode terms of use"]),
    "icu": ("icu", [r"icu licen[sc]e"]),
    "ijg": ("jpeg", [r"independent jpeg group(?: s)? licen[sc]e", r"this software is based in part on the work of the independent jpeg group"]),
    "freetype": ("freetype", [r"freetype (?:project )?licen[sc]e"]),
    "imagemagick": ("imagemagick", [r"imagemagick licen[sc]e"]),
    "tcl": ("tcl", [r"tcl tk licen[sc]e", r"tcl licen[sc]e"]),
    "sleepycat": ("sleepycat", [r"sleepycat licen[sc]e"]),
    "sun-public": ("sun", [r"sun public licen[sc]e(?:# ?1 0)?", r"sun industry standards source licen[sc]e"]),
    "netscape": ("netscape", [r"netscape public licen[sc]e(?:# ?1 [01])?"]),
    "apple-2.0": ("apple", [r"apple public source licen[sc]e(?:# ?[12] [012])?"]),
    "intel": ("intel", [r"intel open source licen[sc]e", r"intel simplified software licen[sc]e"]),
    "nasa-1.3": ("nasa", [r"nasa open source agreement(?:# ?1 3)?"]),
    "lucent": ("lucent", [r"lucent public licen[sc]e(?:# ?1 0[12]?)?"]),
    "nokia": ("nokia", [r"nokia open source licen[sc]e"]),
    "ricoh": ("ricoh", [r"ricoh source code public licen[sc]e"]),
    "qpl-1.0": ("public", [r"q public licen[sc]e(?:# ?1 0)?"]),
    "nposl-3.0": ("profit", [r"non profit open software licen[sc]e(?: 3 0)?"]),
    "upl-1.0": ("permissive", [r"universal permissive licen[sc]e(?:# ?1 0)?"]),
    "blueoak-1.0.0": ("oak", [r"blue oak model licen[sc]e(?: 1 0 0)?"]),
    "cecill": ("cecill", [r"cecill(?: [abc])? (?:free software )?licen[sc]e", r"cecill(?: [abc])?(?: 2 [01])?"]),
    "mulan": ("mulan", [r"mulan p(?:ermissive|sl|ublic)(?: software)?(?: licen[sc]e)?(?: v?[12])?"]),
    "odbl-1.0": ("database", [r"open (?:data commons open )?database licen[sc]e(?: 1 0)?"]),
    "odc-by": ("data", [r"open data commons attribution licen[sc]e", r"odc by"]),
    "pddl": ("dedication", [r"public domain dedication and licen[sc]e"]),
    "cdla-permissive": ("community", [r"community data licen[sc]e agreement permissive(?: [12] 0)?"]),
    "cdla-sharing": ("community", [r"community data licen[sc]e agreement sharing(?: 1 0)?"]),
    "ogl-uk": ("government", [r"open government licen[sc]e(?: v?[123](?: 0)?)?"]),
    "etalab": ("etalab", [r"licence ouverte etalab", r"etalab 2 0"]),
    "openrail": ("openrail", [r"(?:creativeml )?openrail(?: m| plus plus m)?(?: licen[sc]e)?"]),
    "llama": ("llama", [r"llama (?:2 |3 )?community licen[sc]e(?: agreement)?"]),
    "commons-clause": ("clause", [r"commons clause(?: licen[sc]e condition)?"]),
    "polyform": ("polyform", [r"polyform (?:noncommercial|small business|shield|strict) licen[sc]e(?: 1 0 0)?"]),
    "hippocratic": ("hippocratic", [r"hippocratic licen[sc]e(?: [123] [01])?"]),
    "anti-996": ("996", [r"anti 996 licen[sc]e(?: 1 0)?"]),
    "beerware": ("beer", [r"beer ?ware licen[sc]e", r"the beer ware license"]),
    "eula": ("user", [r"end user licen[sc]e agreement"]),
    "proprietary": ("proprietary", [r"proprietary and confidential", r"proprietary licen[sc]e", r"proprietary software"]),
    "all-rights-reserved": ("rights", [r"all rights reserved", r"all rights are reserved"]),
    "copyright": ("copyright", [r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", r"copyright holders?"]),
    "warranty": ("warranty", [r"without warranty of any kind", r"without any warranty"]),
    "no-commercial": ("commercial", [r"(?:not|no) (?:for )?commercial use", r"non commercial use only"]),
    "no-redistribution": ("redistribute", [r"(?:may|do) not (?:be )?(?:copied or )?redistribute"]),
    "no-training": ("training", [r"(?:may not|must not|shall not) be used (?:for|to) train(?:ing)?"]),
    "permission": ("permission", [r"used with permission", r"reprinted with permission"]),
    "licensed-as": ("licensed", [r"dual licensed under", r"multi licensed under", r"licensed under the terms of"]),
    "see-license": ("license", [r"see (?:the )?(?:file )?license(?: txt| md| file)? for (?:details|more information)", r"see the accompanying license file"]),
    "terms-of-service": ("terms", [r"subject to (?:our|the) terms of (?:service|use)"]),
}
#: Keywords of the regexes that match without their family's keyword: every match holds one of them as a word.
OWN_KEYWORDS = {
    r"agpl(?: v)? ?3(?: 0)?(?: only| or later)?": ["agpl", "agpl3"],
    r"agplv3": ["agplv3"],
    r"gnu gpl": ["gpl"],
    r"gplv[123]": ["gplv1", "gplv2", "gplv3"],
    r"lgplv[23]": ["lgplv2", "lgplv3"],
    r"freebsd licen[sc]e": ["freebsd"],
    r"zero clause bsd": ["bsd"],
    r"free public licen[sc]e 1 0 0": ["public"],
    r"berkeley software distribution": ["berkeley"],
    r"redistributions of source code must retain the above copyright": ["redistributions"],
    r"mplv2": ["mplv2"],
    r"creativecommons org licenses by": ["creativecommons"],
    r"psf licen[sc]e": ["psf"],
    r"ms pl": ["pl"],
    r"ms rl": ["rl"],
    r"odc by": ["odc"],
    r"beer ?ware licen[sc]e": ["beer", "beerware"],
    r"(?:may not|must not|shall not) be used (?:for|to) train(?:ing)?": ["train", "training"],
}
#: Signatures that grant or withhold rights by name count fully; notices in passing count less.
WEAK = {"copyright", "warranty", "permission", "see-license", "terms-of-service", "all-rights-reserved", "licensed-as"}


def rule_rows() -> list[tuple[int, str, str, str]]:
    """(priority, keyword, regex, label), the most specific first; a regex with several keywords has a row for each."""
    rows = [(keyword, r, re.sub(r"-(?:long|short|text)$", "", label)) for label, (keyword, rs) in RULES.items() for r in rs]
    return [(i, k, r.replace("#", _V), label) for i, (keyword, r, label) in enumerate(rows) for k in OWN_KEYWORDS.get(r, [keyword])]


def lowered(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(norm: Column, regex: str | Column) -> Column:
    """Places of a regex among words: array of (start, length), both counted in words. ``norm`` has a space on either side of
    every word's run, one space between; the regex stands between two spaces."""
    pattern = F.concat(F.lit("(?<= )(?:"), regex if isinstance(regex, Column) else F.lit(regex), F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, pattern, F.lit(0))
    gaps = F.split(norm, pattern, -1) if isinstance(regex, Column) else F.split(norm, f"(?<= )(?:{regex})(?= )", -1)
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    step = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    whole = F.aggregate(
        F.filter(step, lambda z: z["hit"].isNotNull()),
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda acc, z: F.struct(
            (acc["at"] + count(z["gap"]) + count(z["hit"])).alias("at"),
            F.array_append(
                acc["out"], F.struct((acc["at"] + count(z["gap"]) - 1).alias("start"), (count(z["hit"]) + 1).alias("length"))
            ).alias("out"),
        ),
    )
    return whole["out"]


def scan(scratch: Scratch, docs: DataFrame, rules: list[tuple[int, str, str, str]] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    A text is opened to the rules whose keyword, which every match of theirs holds, is among its words. A detection that lies within another goes; of equal ones
    the rule of higher priority stays. The score is 1 for a strong label of the base, 0.9 for other named
    licenses, 0.5 for notices, else 0. Null and empty texts have no words; repeated rows get equal results; other columns
    are ignored; an empty table gives an empty result.
    """
    rules = rule_rows() if rules is None else rules
    spark = docs.sparkSession
    keywords = sorted({k for _, k, _, _ in rules})
    # Only where a word begins are the keywords tried.
    gate = rf"(?i)(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?:{'|'.join(keywords)})(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    text = F.coalesce("text", F.lit(""))
    # Only texts with a keyword somewhere are lowered and split; the others need their words counted.
    base = docs.select("doc_id", F.xxhash64("text").alias("_th"), text.alias("text"))
    n_words = F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    opened = F.col("text").rlike(gate)
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(F.col("text")), GAP, " ")), F.lit(" "))
    # Written once, as labels and counts both need it.
    rows = scratch.keep(base.select("doc_id", "_th", n_words.alias("n_words"), F.when(opened, norm).alias("norm")))
    struct = [places(F.col("norm"), p)["start"].alias(label) for p, label in BASE.items()]
    rows = rows.withColumn("_b", F.when(F.col("norm").rlike("(?<= )(?:" + "|".join(BASE) + ")(?= )"), F.struct(*struct)))
    starts = F.flatten(F.array(*[F.col(f"_b.{label}") for label in BASE.values()]))
    found = F.array_compact(F.array(*[F.when(F.size(F.col(f"_b.{label}")) > 0, F.lit(label)) for label in BASE.values()]))
    facts = rows.select(
        "doc_id", "_th", "n_words", "norm",
        F.when(F.col("_b").isNotNull(), F.size(starts)).otherwise(0).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>")).alias("_base"),
    )
    table = F.broadcast(spark.createDataFrame(rules, "priority int, keyword string, regex string, label string"))  # the fixed rules
    words = F.array_intersect(F.split("norm", " "), F.array(*map(F.lit, keywords)))
    gated = rows.where("norm is not null").select("doc_id", "_th", "norm", F.explode(words).alias("keyword")).join(table, "keyword")
    hits = gated.select("doc_id", "_th", "priority", "label", F.explode(F.array_distinct(places(F.col("norm"), F.col("regex")))).alias("z"))
    hits = hits.selectExpr("doc_id", "_th", "priority", "label", "z.start as start", "z.start + z.length as stop").distinct()
    hits = hits.selectExpr(
        "*",
        "max(stop) over (partition by doc_id, _th order by start, stop desc, priority rows between unbounded preceding and 1 preceding) as reach",
    )
    labels = hits.where("reach is null or reach < stop").groupBy("doc_id", "_th").agg(F.collect_set("label").alias("_found"))
    same = F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("f._th").eqNullSafe(F.col("l._th"))
    out = facts.drop("norm").alias("f").join(labels.alias("l"), same, "left").select("f.*", "_found")
    both = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))))
    strong = F.size(F.array_except("_l", F.array(*map(F.lit, sorted(WEAK))))) > 0
    score = F.when(F.size("_base") > 0, 1.0).when(strong, 0.9).when(F.size("_l") > 0, 0.5).otherwise(0.0)
    return out.withColumn("_l", both).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join("_l", ",").alias("labels"), score.alias("score"),
    )


def op6_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every whole text."""
    return scan(Scratch(spark), documents(spark, sf_dir))


QUERIES = {"op6_signatures": op6_signatures}
