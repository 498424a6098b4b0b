"""Names of authors: who is one, and when two spellings are one person."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Words that mark an organisation, whole names that are none of an author, and
# public figures who are no literary authors.
ORGANISATION_WORDS = (
    "press university publishing publications publisher publishers magazine comics comic association institute council commission society societies foundation committee ministry bureau "
    "incorporated inc studios studio entertainment productions production media llc ltd nations geographic vatican department agency review books book club bbc cnn npr editorial news audubon "
    "times company group gazette herald tribune journal chronicle worldwide kennel programs program project projects ministries syndicate globe corps government illustrated library libraries "
    "museum gallery academy academies college congress administration corporation radio records anonymous international scientist economist housekeeping pediatrics prospectus guides workshop "
    "team fund scholastic encyclopedia dictionary almanac"
).split()
STOP_NAMES = [
    "the new yorker", "the beatles", "lonely planet", "the state", "founding fathers", "the founding fathers", "the un", "un", "u.n.", "the u.n.", "not a book", "anonymous", "various", "unknown",
    "random house", "vanity fair", "the catholic church", "church of england", "episcopal church", "the poetry center", "the college board", "better homes", "real simple", "taste of home",
    "american girl", "american heritage", "american poetry", "the american poetry", "wizards of the coast", "boy scouts of america", "monks of new skete", "symphony space", "barron's", "the bark",
    "the harvard lampoon", "the onion", "the wire", "the doors", "the clash", "the rolling stones", "the who",
]
PUBLIC_FIGURES = [
    "abraham lincoln", "george washington", "barack obama", "thomas jefferson", "winston churchill", "adolf hitler", "queen victoria", "john f. kennedy", "ronald reagan", "george w. bush",
    "benjamin franklin", "bill clinton", "theodore roosevelt", "robert e. lee", "elizabeth i", "nelson mandela", "fidel castro", "martin luther king jr.", "martin luther king", "martin luther",
    "ulysses s. grant", "eleanor roosevelt", "malcolm x", "john adams", "andrew jackson", "margaret thatcher", "jimmy carter", "marco polo", "mother teresa", "albert einstein", "charles darwin",
    "sigmund freud", "isaac newton", "richard dawkins", "michel foucault", "william james", "karl marx", "bill gates", "bob dylan", "john lennon", "michael jackson", "david bowie", "marilyn monroe",
    "alfred hitchcock", "woody allen", "steven spielberg", "orson welles", "elizabeth taylor", "andy warhol", "babe ruth", "muhammad ali", "jackie robinson", "oprah winfrey", "martha stewart",
    "james beard", "jack frost",
]
#: Forms the merging rule cannot repair, by token key.
ALIASES = {"william butler": "wb yeats", "yeats": "wb yeats", "george r r martin": "george rr martin"}


def is_organisation(name) -> Column:
    low = F.lower(collapse(name))
    tokens = F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1))
    return low.isin(*STOP_NAMES) | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ORGANISATION_WORDS]))


def is_excluded(name) -> Column:
    """Organisations, publishers and public figures."""
    return is_organisation(name) | F.lower(collapse(name)).isin(*PUBLIC_FIGURES)


#: Fixed value: a run of capitalised words, with lower case joiners inside.
CAPITAL_RUN = r"[A-Z][A-Za-z.'’-]*(?:\s+(?:of|the|and|in|to|for|a|an|de|van|von|le|la|du|del|der|on|at|by|with|[A-Z][A-Za-z.'’-]*))*\s+[A-Z][A-Za-z.'’-]*"


def capital_runs(c) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({CAPITAL_RUN})"), F.lit(1))
