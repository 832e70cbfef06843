"""Word lists, and what a word is by them. Lists are parameters; these are the defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these words and patterns.
STOP = """a about after again also an and are as at be been being by can could did do does during each for from had has
have he hence her his how in into is it its may more most of on one only or our over same she should some such than that
the their then there these they thing this those through to under was we were what when where which while who will with
would you your""".split()
OCR_NOISE = """ahi anpuk bay bid boyd bre chine con cow ction diph diphin dy facilis fhe fof fov foy fre gnd golpd ha hay
hhe ho hoo hos hoy ithe jod lory man mle mookel oh op ore ote ov pd qnd qonevade te th ting tk ut veevnbeys ving wih
wnemy yo ym""".split()
DOMAIN = """algorithm assignment automata basics blockchain capability certificate chapter college completion computer
control course database document engineering exam finite input internal machine marks mathematics memory model module
notes output paper presentation project question read search semester student summit syllabus system tape technical
theory turing unit write""".split()
COMMON = """ability abstract accepted access according account accuracy action activity addition address advanced
advantage analysis answer application approach architecture array article assessment associated available award awarded
basic basis block body book business case cell cells certain class code collection common communication complete
completed concept condition connected consider constant content context created data date deadline defined definition
degree department description design detail determine development diagram difference different differential digital
discussion division education effect efficient element example examples evaluation exercise experience expires explain
expression external feature field file final flow folder form format fourier function general generate given group head
image important include individual information instruction integer introduction lecture lesson level list local logic
management method network number numerical object operation order organise organiser organized original page partial
path pattern personal point possible practical practice problem process produce program purpose quality reason record
reference related report required research result review rubric rule sample section sequence service signal solution
state statistical store structure subject success successful suggestion summary support table techniques term test text
topic transform type value version work workflow""".split()
IDENTIFIERS = (r"^[a-z]{2,6}\d{2,4}$", r"^(unit|chapter|module|lesson|assignment|lab|practical)\d{1,3}$", r"^(math|maths)\d{1,4}$")
CORRECTIONS = (
    (r"^(tusing|tuving|toving|taving|tuning|tsing|trig|tung|tiving|taxing)$", "turing"),
    (r"^(maching|moching|macking|mackie|mochine|wachine|wockine|mocking|mocked|mocks|mache)$", "machine"),
    (r"^(mamory|momewy|wemoy|memoy|memy|wemowy|wemory)$", "memory"),
    (r"^(inpud|imput|inpat|imput|inputl|inbut)$", "input"),
    (r"^(outpd|oudpd|ausput|oulpd|ouput|oulput|gulped|solped)$", "output"),
    (r"^(tepe|jape|dope|dape)$|^(tape)$", "tape"),
    (r"^(firite|frite|finile|fihite|firide|fide|finite)$", "finite"),
    (r"^(conbvol|corbvol|contvol|corthol|cortvol|conhval|control)$", "control"),
    (r"^(copability|copabili|capabili|capabily|capabisity|cpobility)$", "capability"),
    (r"^(computing|conputing|compicting|conpucting|compting)$", "computing"),
)


def plain(word: Column) -> Column:
    """a-z and digits of a word, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), "[^a-z0-9]", "")


def spelled_out(corrections=CORRECTIONS) -> dict[str, str] | None:
    """Corrections that only list words as a table (the first one counts); None if a pattern is more than that."""
    out: dict[str, str] = {}
    for pattern, right in corrections:
        if not re.fullmatch(r"\^\([a-z|]+\)\$(\|\^\([a-z|]+\)\$)*", pattern):
            return None
        for word in re.findall("[a-z]+", pattern):
            out.setdefault(word, right)
    return out


def corrected(word: Column) -> Column:
    """The first correction that fits. Those that list words are one look-up in a set, and in a table where it hits."""
    known = spelled_out()
    if known is not None:
        table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
        return F.when(word.isin(*known), F.try_element_at(table, word)).otherwise(word)
    out = None
    for pattern, right in CORRECTIONS:
        out = F.when(word.rlike(pattern), right) if out is None else out.when(word.rlike(pattern), right)
    return out.otherwise(word)


def plain_identifier(w: Column) -> Column:
    """is_identifier() of a word that is plain() already."""
    some = w.rlike(IDENTIFIERS[0])
    for p in IDENTIFIERS[1:]:
        some = some | w.rlike(p)
    return w.rlike("[0-9]") & F.length(w).between(4, 12) & w.rlike("[a-z]") & ~w.rlike(r"(.)\1{3,}") & some


def is_identifier(word: Column) -> Column:
    """A course or unit number, such as bcs303."""
    return plain_identifier(plain(word))


def plain_plausible(w: Column) -> Column:
    """is_plausible() of a word that is plain() already."""
    return w.rlike(r"^(?=[^aeiou]*[aeiou])(?!.*[bcdfghjklmnpqrstvwxyz]{5})(?!.*[aeiou]{4})[a-z]{4,18}\z")


def is_plausible(word: Column) -> Column:
    """Shaped like a word: 4 to 18 letters with vowels, no long run of consonants or vowels."""
    return plain_plausible(plain(word))


def signal(word: Column, stop=STOP, noise=OCR_NOISE, domain=DOMAIN, common=COMMON) -> Column:
    """One of empty, identifier, noise, stop, domain, dictionary, unknown-plausible and unknown-noisy."""
    w = plain(word)
    return (F.when(w == "", "empty").when(is_identifier(w), "identifier").when(w.isin(*noise), "noise").when(w.isin(*stop), "stop")
            .when(w.isin(*domain), "domain").when(w.isin(*common), "dictionary").when(is_plausible(w), "unknown-plausible")
            .otherwise("unknown-noisy"))


def merged(common=COMMON, domain=DOMAIN) -> list[str]:
    """Known words: common ones and those of the domain, each once."""
    return list(dict.fromkeys([*common, *domain]))


def sizes(stop=STOP, noise=OCR_NOISE, domain=DOMAIN, common=COMMON) -> dict[str, int]:
    """How many different words each list has."""
    return {"stop": len(set(stop)), "noise": len(set(noise)), "domain": len(set(domain)), "common": len(merged(common, domain)), "corrections": len(CORRECTIONS)}
