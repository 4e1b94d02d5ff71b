"""Signature rules of the license scan: plain patterns over lower-cased text, most specific first.

A rule is (label, kind, gates, pattern). Kinds in order of priority: ``notice`` (the
wording of a license or its grant), ``tag`` (a machine-readable identifier), ``url``,
``reference`` (a license named as a license), ``mention`` (its name alone). A gate is a
list of keywords; a rule is tried only on texts that contain one of each gate, and one
gate is always the license's own.
"""

from __future__ import annotations

import re

PRIORITY = {"notice": 5, "tag": 4, "url": 3, "reference": 2, "mention": 1}
WEIGHT = {"notice": 1.0, "tag": 0.95, "url": 0.9, "reference": 0.8, "mention": 0.5}

_S = r"[\s\W_]+"  # between words
_V = r"(?:,?\s*(?:(?:version|v\.?)\s*)?)"  # before a version

# label; identifier in tags; keywords, one of which is in every match of the name; name in prose; URL, or None
LICENSES = [
    ("mit", r"mit", "mit", r"mit", r"opensource\.org/licen[sc]es?/mit\b"),
    ("mit-0", r"mit-0", "mit", rf"mit{_S}(?:no{_S}attribution|0)", r"opensource\.org/licen[sc]es?/mit-0"),
    ("x11", r"x11", "x11", r"x11", r"spdx\.org/licenses/x11"),
    ("apache-1.1", r"apache-1\.1", "apache", rf"apache(?:{_S}software)?(?:{_S}licen[sc]e)?{_V}1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2", r"apache-2(?:\.0)?", "apache", rf"apache(?:{_S}software)?(?:{_S}licen[sc]e)?{_V}2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("bsd-2-clause", r"bsd-2-clause", "bsd", rf"(?:bsd{_S}(?:2|two){_S}clause|(?:2|two){_S}clause{_S}bsd|simplified{_S}bsd|freebsd)", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("bsd-3-clause", r"bsd-3-clause", "bsd", rf"(?:bsd{_S}(?:3|three){_S}clause|(?:3|three){_S}clause{_S}bsd|(?:new|revised|modified){_S}bsd)", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("bsd-4-clause", r"bsd-4-clause", "bsd", rf"(?:bsd{_S}(?:4|four){_S}clause|(?:4|four){_S}clause{_S}bsd|original{_S}bsd)", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", r"0bsd", "bsd", rf"(?:zero{_S}clause{_S}bsd|0bsd|bsd{_S}zero{_S}clause)", r"opensource\.org/licen[sc]es?/0bsd"),
    ("gpl-2", r"gpl-2\.0(?:-only|\+|-or-later)?", "gpl", rf"(?:gnu{_S})?gpl{_V}2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3", r"gpl-3\.0(?:-only|\+|-or-later)?", "gpl", rf"(?:gnu{_S})?gpl{_V}3(?:\.0)?", r"gnu\.org/licenses/gpl(?:-3\.0)?\b"),
    ("gpl-2", r"gnu-gpl-2", "gnu", rf"gnu{_S}general{_S}public{_S}licen[sc]e{_V}2(?:\.0)?", None),
    ("gpl-3", r"gnu-gpl-3", "gnu", rf"gnu{_S}general{_S}public{_S}licen[sc]e{_V}3(?:\.0)?", None),
    ("gpl", r"gpl", "gnu", rf"gnu{_S}general{_S}public{_S}licen[sc]e", r"gnu\.org/copyleft/gpl"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|\+|-or-later)?", "lgpl|lesser", rf"(?:lgpl|(?:gnu{_S})?lesser{_S}general{_S}public{_S}licen[sc]e){_V}2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3", r"lgpl-3\.0(?:-only|\+|-or-later)?", "lgpl|lesser", rf"(?:lgpl|(?:gnu{_S})?lesser{_S}general{_S}public{_S}licen[sc]e){_V}3(?:\.0)?", r"gnu\.org/licenses/lgpl(?:-3\.0)?\b"),
    ("lgpl", r"lgpl", "lesser|library", rf"(?:gnu{_S})?(?:lesser|library){_S}general{_S}public{_S}licen[sc]e", r"gnu\.org/copyleft/lesser"),
    ("agpl-3", r"agpl-3\.0(?:-only|\+|-or-later)?", "agpl|affero", rf"(?:agpl|(?:gnu{_S})?affero{_S}general{_S}public{_S}licen[sc]e){_V}3(?:\.0)?", r"gnu\.org/licenses/agpl(?:-3\.0)?\b"),
    ("agpl", r"agpl", "affero", rf"(?:gnu{_S})?affero{_S}general{_S}public{_S}licen[sc]e", r"affero\.org/oagpl"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", "documentation", rf"gnu{_S}free{_S}documentation{_S}licen[sc]e", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("mpl-1.1", r"mpl-1\.1", "mpl|mozilla", rf"(?:mpl|mozilla{_S}public{_S}licen[sc]e){_V}1\.1", r"mozilla\.org/mpl/(?:1\.1|mpl-1\.1)"),
    ("mpl-2", r"mpl-2\.0", "mpl|mozilla", rf"(?:mpl|mozilla{_S}public{_S}licen[sc]e){_V}2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1", r"epl-1\.0", "epl|eclipse", rf"(?:epl|eclipse{_S}public{_S}licen[sc]e){_V}1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2", r"epl-2\.0", "epl|eclipse", rf"(?:epl|eclipse{_S}public{_S}licen[sc]e){_V}2(?:\.0)?", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("edl-1", r"edl-1\.0", "eclipse", rf"eclipse{_S}distribution{_S}licen[sc]e", r"eclipse\.org/org/documents/edl"),
    ("cddl-1", r"cddl-1\.[01]", "cddl|common", rf"(?:cddl|common{_S}development{_S}and{_S}distribution{_S}licen[sc]e)", r"opensource\.org/licen[sc]es?/cddl"),
    ("cpl-1", r"cpl-1\.0", "common", rf"common{_S}public{_S}licen[sc]e", r"opensource\.org/licen[sc]es?/cpl"),
    ("eupl-1.2", r"eupl-1\.2", "eupl|european", rf"(?:eupl|european{_S}union{_S}public{_S}licen[sc]e){_V}1\.2", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cc0-1", r"cc0-1\.0", "cc0", r"cc0(?:\s*1\.0)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", r"cc-by-[1234]\.0", "cc", r"cc[\s-]by(?![\s-]*(?:nc|sa|nd)\b)", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", r"cc-by-sa-[1234]\.0", "cc", r"cc[\s-]by[\s-]sa", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nd", r"cc-by-nd-[1234]\.0", "cc", r"cc[\s-]by[\s-]nd", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc", r"cc-by-nc-[1234]\.0", "cc", r"cc[\s-]by[\s-]nc(?![\s-]*(?:sa|nd)\b)", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1234]\.0", "cc", r"cc[\s-]by[\s-]nc[\s-]sa", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1234]\.0", "cc", r"cc[\s-]by[\s-]nc[\s-]nd", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("isc", r"isc", "isc", r"isc", r"opensource\.org/licen[sc]es?/isc"),
    ("zlib", r"zlib", "zlib", r"zlib(?:/libpng)?", r"(?:zlib\.net/zlib_license|opensource\.org/licen[sc]es?/zlib)"),
    ("unlicense", r"unlicense", "unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"wtfpl", "wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("boost-1", r"bsl-1\.0", "boost", rf"boost{_S}software{_S}licen[sc]e", r"boost\.org/license_1_0"),
    ("artistic-2", r"artistic-2\.0", "artistic", rf"artistic{_S}licen[sc]e{_V}2(?:\.0)?", r"opensource\.org/licen[sc]es?/artistic-(?:license-)?2\.0"),
    ("artistic-1", r"artistic-1\.0(?:-perl)?", "artistic", rf"artistic{_S}licen[sc]e{_V}1(?:\.0)?", r"opensource\.org/licen[sc]es?/artistic-1\.0"),
    ("afl-3", r"afl-3\.0", "academic", rf"academic{_S}free{_S}licen[sc]e", r"opensource\.org/licen[sc]es?/afl-3\.0"),
    ("osl-3", r"osl-3\.0", "software", rf"open{_S}software{_S}licen[sc]e", r"opensource\.org/licen[sc]es?/osl-3\.0"),
    ("ofl-1.1", r"ofl-1\.1", "font", rf"sil{_S}open{_S}font{_S}licen[sc]e", r"scripts\.sil\.org/ofl"),
    ("ncsa", r"ncsa", "ncsa", rf"(?:university{_S}of{_S}illinois/)?ncsa{_S}open{_S}source{_S}licen[sc]e", r"opensource\.org/licen[sc]es?/ncsa"),
    ("psf-2", r"(?:psf|python)-2\.0", "python", rf"python{_S}software{_S}foundation{_S}licen[sc]e", r"docs\.python\.org/\S*license"),
    ("php-3", r"php-3\.0[01]?", "php", rf"php{_S}licen[sc]e", r"php\.net/license/3_0"),
    ("ruby", r"ruby", "ruby", rf"ruby{_S}licen[sc]e", r"ruby-lang\.org/\S*license"),
    ("openssl", r"openssl", "openssl", rf"openssl{_S}licen[sc]e", r"openssl\.org/source/license"),
    ("curl", r"curl", "curl", rf"curl{_S}licen[sc]e", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    ("ms-pl", r"ms-pl", "microsoft", rf"microsoft{_S}public{_S}licen[sc]e", r"opensource\.org/licen[sc]es?/ms-pl"),
    ("ms-rl", r"ms-rl", "microsoft", rf"microsoft{_S}reciprocal{_S}licen[sc]e", r"opensource\.org/licen[sc]es?/ms-rl"),
    ("upl-1", r"upl-1\.0", "permissive", rf"universal{_S}permissive{_S}licen[sc]e", r"opensource\.org/licen[sc]es?/upl"),
    ("bsl-1.1", r"busl-1\.1", "business", rf"business{_S}source{_S}licen[sc]e", r"mariadb\.com/bsl11"),
    ("sspl-1", r"sspl-1\.0", "server", rf"server{_S}side{_S}public{_S}licen[sc]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2", r"elastic-2\.0", "elastic", rf"elastic{_S}licen[sc]e", r"elastic\.co/licensing/elastic-license"),
    ("odbl-1", r"odbl-1\.0", "database", rf"open{_S}(?:data{_S}commons{_S}open{_S})?database{_S}licen[sc]e", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1", r"odc-by-1\.0", "commons", rf"open{_S}data{_S}commons{_S}attribution{_S}licen[sc]e", r"opendatacommons\.org/licenses/by"),
    ("pddl-1", r"pddl-1\.0", "dedication", rf"public{_S}domain{_S}dedication{_S}and{_S}licen[sc]e", r"opendatacommons\.org/licenses/pddl"),
    ("postgresql", r"postgresql", "postgresql", rf"postgresql{_S}licen[sc]e", r"postgresql\.org/about/licence"),
    ("vim", r"vim", "vim", rf"vim{_S}licen[sc]e", None),
    ("w3c", r"w3c", "w3c", rf"w3c{_S}software{_S}(?:notice{_S}and{_S})?licen[sc]e", r"w3\.org/consortium/legal/\S*software"),
    ("openrail-m", r"(?:creativeml-)?openrail-m", "rail", rf"(?:creativeml{_S})?open{_S}?rail(?:{_S}m)?(?:\+\+)?", r"huggingface\.co/spaces/\S*license"),
    ("llama-community", r"llama[\d.]*", "llama", rf"llama{_S}[\d.]*{_S}?community{_S}licen[sc]e", None),
]

# (label, keyword, pattern): wording that stands for a license without naming it, and grants
NOTICES = [
    ("mit", "hereby", rf"permission{_S}is{_S}hereby{_S}granted,?{_S}free{_S}of{_S}charge,?{_S}to{_S}any{_S}person{_S}obtaining{_S}a{_S}copy"),
    ("mit", "mit", rf"(?:released|licensed|distributed|available){_S}under{_S}the{_S}(?:terms{_S}of{_S}the{_S})?mit{_S}licen[sc]e"),
    ("isc", "permission", rf"permission{_S}to{_S}use,?{_S}copy,?{_S}modify,?{_S}and/or{_S}distribute{_S}this{_S}software"),
    ("apache-2", "apache", rf"licensed{_S}under{_S}the{_S}apache{_S}licen[sc]e,?{_S}version{_S}2(?:\.0)?"),
    ("apache-2", "apache", rf"apache{_S}licen[sc]e{_S}version{_S}2\.0,{_S}january{_S}2004"),
    ("bsd", "redistribution", rf"redistribution{_S}and{_S}use{_S}in{_S}source{_S}and{_S}binary{_S}forms"),
    ("bsd-3-clause", "endorse", rf"neither{_S}the{_S}name{_S}of[^.]{{1,200}}?endorse{_S}or{_S}promote{_S}products"),
    ("bsd-4-clause", "advertising", rf"all{_S}advertising{_S}materials{_S}mentioning{_S}features"),
    ("gpl-3", "gnu", rf"(?:licensed|released|distributed|redistribute)[^.\n]{{0,120}}?gnu{_S}general{_S}public{_S}licen[sc]e[^.\n]{{0,80}}?version{_S}3(?:\.0)?"),
    ("gpl-2", "gnu", rf"(?:licensed|released|distributed|redistribute)[^.\n]{{0,120}}?gnu{_S}general{_S}public{_S}licen[sc]e[^.\n]{{0,80}}?version{_S}2(?:\.0)?"),
    ("gpl", "gnu", rf"this{_S}program{_S}is{_S}free{_S}software[^.]{{0,200}}?gnu{_S}general{_S}public{_S}licen[sc]e"),
    ("lgpl", "lesser", rf"this{_S}library{_S}is{_S}free{_S}software[^.]{{0,200}}?lesser{_S}general{_S}public{_S}licen[sc]e"),
    ("agpl", "affero", rf"terms{_S}of{_S}the{_S}gnu{_S}affero{_S}general{_S}public{_S}licen[sc]e"),
    ("mpl-2", "mozilla", rf"subject{_S}to{_S}the{_S}terms{_S}of{_S}the{_S}mozilla{_S}public{_S}licen[sc]e,?{_S}v\.?{_S}?2\.0"),
    ("cc-by", "commons", rf"creative{_S}commons{_S}attribution(?![\s-]*(?:non|share|no))"),
    ("cc-by-sa", "commons", rf"creative{_S}commons{_S}attribution{_S}share{_S}?alike"),
    ("cc-by-nc", "commons", rf"creative{_S}commons{_S}attribution{_S}non{_S}?commercial(?![\s-]*(?:share|no))"),
    ("cc-by-nc-sa", "commons", rf"creative{_S}commons{_S}attribution{_S}non{_S}?commercial{_S}share{_S}?alike"),
    ("cc-by-nd", "commons", rf"creative{_S}commons{_S}attribution{_S}no{_S}?deriv(?:ative)?s?"),
    ("cc-by-nc-nd", "commons", rf"creative{_S}commons{_S}attribution{_S}non{_S}?commercial{_S}no{_S}?deriv(?:ative)?s?"),
    ("cc-by-nc", "cc", rf"licensed{_S}under{_S}cc{_S}by{_S}nc(?:{_S}[1234]\.0)?(?![\s-]*(?:sa|nd)\b)"),
    ("cc-by", "cc", rf"licensed{_S}under{_S}cc{_S}by(?:{_S}[1234]\.0)?(?![\s-]*(?:nc|sa|nd)\b)"),
    ("zlib", "implied", rf"this{_S}software{_S}is{_S}provided{_S}'?as-is'?,?{_S}without{_S}any{_S}express{_S}or{_S}implied{_S}warranty"),
    ("unlicense", "unencumbered", rf"free{_S}and{_S}unencumbered{_S}software{_S}released{_S}into{_S}the{_S}public{_S}domain"),
    ("public-domain", "domain", rf"(?:released|dedicated|placed|is){_S}(?:in|into|to){_S}the{_S}public{_S}domain"),
    ("wtfpl", "what", rf"do{_S}what{_S}the{_S}f\w+{_S}you{_S}want{_S}to{_S}public{_S}licen[sc]e"),
    ("boost-1", "boost", rf"distributed{_S}under{_S}the{_S}boost{_S}software{_S}licen[sc]e"),
    ("all-rights-reserved", "reserved", rf"all{_S}rights{_S}reserved"),
    ("proprietary", "proprietary", rf"proprietary{_S}and{_S}confidential"),
    ("apache-2", "prominent", rf"cause{_S}any{_S}modified{_S}files{_S}to{_S}carry{_S}prominent{_S}notices{_S}stating{_S}that{_S}you{_S}changed"),
    ("x11", "consortium", rf"except{_S}as{_S}contained{_S}in{_S}this{_S}notice,?{_S}the{_S}name{_S}of{_S}the{_S}x{_S}consortium"),
    ("zlib", "plainly", rf"altered{_S}source{_S}versions{_S}must{_S}be{_S}plainly{_S}marked{_S}as{_S}such"),
    ("ncsa", "disclaimers", rf"retain{_S}the{_S}above{_S}copyright{_S}notice,?{_S}this{_S}list{_S}of{_S}conditions{_S}and{_S}the{_S}following{_S}disclaimers"),
    ("postgresql", "written", rf"for{_S}any{_S}purpose,?{_S}without{_S}fee,?{_S}and{_S}without{_S}a{_S}written{_S}agreement"),
    ("mpl-1.1", "mozilla", rf"contents{_S}of{_S}this{_S}file{_S}are{_S}subject{_S}to{_S}the{_S}mozilla{_S}public{_S}licen[sc]e{_S}version{_S}1\.1"),
    ("mpl-2", "mozilla", rf"this{_S}source{_S}code{_S}form{_S}is{_S}subject{_S}to{_S}the{_S}terms{_S}of{_S}the{_S}mozilla"),
    ("epl-1", "eclipse", rf"accompanying{_S}materials{_S}are{_S}made{_S}available{_S}under{_S}the{_S}terms{_S}of{_S}the{_S}eclipse{_S}public{_S}licen[sc]e{_V}1"),
    ("epl-2", "eclipse", rf"accompanying{_S}materials{_S}are{_S}made{_S}available{_S}under{_S}the{_S}terms{_S}of{_S}the{_S}eclipse{_S}public{_S}licen[sc]e{_V}2"),
    ("cddl-1", "common", rf"subject{_S}to{_S}the{_S}terms{_S}of{_S}the{_S}common{_S}development{_S}and{_S}distribution{_S}licen[sc]e"),
    ("cpl-1", "common", rf"under{_S}the{_S}terms{_S}of{_S}this{_S}common{_S}public{_S}licen[sc]e"),
    ("eupl-1.2", "eupl", rf"licensed{_S}under{_S}the{_S}eupl"),
    ("gfdl", "documentation", rf"copy,?{_S}distribute{_S}and/or{_S}modify{_S}this{_S}document{_S}under{_S}the{_S}terms{_S}of{_S}the{_S}gnu{_S}free{_S}documentation"),
    ("agpl-3", "remotely", rf"offer{_S}all{_S}users{_S}interacting{_S}with{_S}it{_S}remotely{_S}through{_S}a{_S}computer{_S}network"),
    ("cc0-1", "waived", rf"waived{_S}all{_S}copyright{_S}and{_S}related{_S}or{_S}neighbou?ring{_S}rights"),
    ("ofl-1.1", "font", rf"this{_S}font{_S}software{_S}is{_S}licensed{_S}under{_S}the{_S}sil{_S}open{_S}font"),
    ("odbl-1", "database", rf"this{_S}[^.\n]{{1,80}}?is{_S}made{_S}available{_S}under{_S}the{_S}open{_S}database{_S}licen[sc]e"),
    ("openssl", "openssl", rf"this{_S}product{_S}includes{_S}software{_S}developed{_S}by{_S}the{_S}openssl{_S}project"),
    ("php-3", "php", rf"this{_S}product{_S}includes{_S}php{_S}software"),
    ("psf-2", "psf", rf"psf{_S}hereby{_S}grants{_S}licensee{_S}a{_S}nonexclusive"),
    ("ms-pl", "accompanying", rf"this{_S}licen[sc]e{_S}governs{_S}use{_S}of{_S}the{_S}accompanying{_S}software"),
    ("artistic-1", "package", rf"copyright{_S}holder{_S}maintains{_S}some{_S}semblance{_S}of{_S}artistic{_S}control"),
    ("elastic-2", "hosted", rf"may{_S}not{_S}provide{_S}the{_S}software{_S}to{_S}third{_S}parties{_S}as{_S}a{_S}hosted{_S}or{_S}managed{_S}service"),
    ("upl-1", "larger", rf"larger{_S}works?{_S}\(as{_S}defined{_S}below\)"),
    ("w3c", "w3c", rf"this{_S}work{_S}is{_S}being{_S}provided{_S}by{_S}the{_S}copyright{_S}holders{_S}under{_S}the{_S}(?:following{_S}licen[sc]e|w3c)"),
    ("curl", "daniel", rf"copyright{_S}\(c\)[^.\n]{{0,40}}?daniel{_S}stenberg"),
    ("proprietary", "unauthor", rf"unauthori[sz]ed{_S}(?:copying|reproduction|distribution)[^.]{{0,80}}?prohibited"),
]


class Rule:
    def __init__(self, order: int, label: str, kind: str, gates: list[list[str]], pattern: str) -> None:
        self.order, self.label, self.kind, self.gates = order, label, kind, gates
        self.pattern = re.compile(pattern)

    def opened_by(self, seen: set[str]) -> bool:
        return all(not seen.isdisjoint(gate) for gate in self.gates)


def _literal(pattern: str) -> str:
    """The plain text that a pattern begins with; none of it is optional in the patterns here."""
    return re.match(r"(?:[a-z0-9/-]|\\\.)*", pattern)[0].replace("\\.", ".")


def all_rules() -> list[Rule]:
    """Hundreds of rules in their order: notices first, then each license's tag, URL, reference and mention."""
    out: list[tuple] = [(label, "notice", [keyword.split("|")], pattern) for label, keyword, pattern in NOTICES]
    for label, tag, keyword, name, url in LICENSES:
        named = [[_literal(tag)]] if _literal(tag) else []
        keywords = keyword.split("|")
        out.append((label, "tag", [["spdx-license-identifier"], *named], rf"spdx-license-identifier:[ \t]*(?:\([^)\n]*)?{tag}(?![\w.-])"))
        out.append((label, "tag", [["license", "licence"], *named], rf"[\"']?licen[sc]es?[\"']?\s*[:=]\s*[\[{{(]?\s*[\"']?{tag}[\"']?(?![\w.-])"))
        if url:
            out.append((label, "url", [[_literal(url)] if _literal(url) else ["zlib.net", "opensource.org"]], url))
        out.append((label, "reference", [["under", "licen", "terms"], keywords], rf"(?:under|licen[sc]ed?|terms{_S}of){_S}(?:the{_S})?(?:terms{_S}of{_S}(?:the{_S})?)?{name}(?![\w])"))
        out.append((label, "mention", [keywords], rf"(?<![\w]){name}{'' if 'licen' in name else rf'{_S}licen[sc]e'}(?![\w])"))
    return [Rule(i, *r) for i, r in enumerate(out)]
