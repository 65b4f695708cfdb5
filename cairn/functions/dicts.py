"""Dictionaries of address words and the expressions that apply them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street suffixes after USPS Publication 28, Appendix C1, as
# "abbreviation: names and spellings". Case does not matter. A form with /s has
# a plural too, with the same ending on either side.
POST_TYPES = """
Accss: Access, Acc
Aly: Alley, Allee, Ally, Al
Anx: Annex, Anex, Annx
Arc: Arcade
Ave: Avenue, Av, Aven, Avenu, Avn, Avnue
Byu: Bayou, Bayoo
Bch: Beach
Bnd: Bend
Blf/s: Bluff/s, Bluf
Btm: Bottom, Bot, Bottm
Blvd: Boulevard, Boul, Boulv, Blvrd, Bv, Bl
Br: Branch, Brnch
Brg: Bridge, Brdge
Brk/s: Brook/s
Bg/s: Burg/s
Byp: Bypass, Bypa, Bypas, Byps
Cp: Camp, Cmp
Cyn: Canyon, Canyn, Cnyn
Cpe: Cape
Cswy: Causeway, Causwa
Ctr/s: Center/s, Cen, Cent, Centr, Centre, Cntr
Cir/s: Circle/s, Circ, Circl, Crcl, Crcle, Cr, Ci
Clf/s: Cliff/s
Clb: Club
Cmn/s: Common/s
Cor/s: Corner/s
Crse: Course
Ct/s: Court/s
Cv/s: Cove/s
Crk: Creek
Cres: Crescent, Crsent, Crsnt, Crsc
Crst: Crest
Xing: Crossing, Crssng
Xrd/s: Crossroad/s
Curv: Curve
Dl: Dale
Dam
Dv: Divide, Div, Dvd
Dr/s: Drive/s, Driv, Drv
Est/s: Estate/s
Expy: Expressway, Exp, Expr, Express, Expw
Ext/s: Extension/s, Extn, Extnsn
Fall
Fls: Falls
Fry: Ferry, Frry
Fld/s: Field/s
Flt/s: Flat/s
Frd/s: Ford/s
Frst: Forest, Forests
Frg/s: Forge/s, Forg
Frk/s: Fork/s
Ft: Fort, Frt
Fwy: Freeway, Freewy, Frway, Frwy
Gdn/s: Garden/s, Gardn, Grden, Grdn/s
Gtwy: Gateway, Gatewy, Gatway, Gtway
Gln/s: Glen/s
Grn/s: Green/s
Grv/s: Grove/s, Grov
Hbr/s: Harbor/s, Harb, Harbr, Hrbor
Hvn: Haven
Hts: Heights, Ht
Hwy: Highway, Highwy, Hiway, Hiwy, Hway, Hgwy, Hw, Hywy
Hl/s: Hill/s
Holw: Hollow, Hllw, Hollows, Holws
Inlt: Inlet
Is: Island, Islnd
Iss: Islands, Islnds
Isle: Isles
Jct/s: Junction/s, Jction, Jctn/s, Junctn, Juncton
Ky/s: Key/s
Knl/s: Knoll/s, Knol
Lk/s: Lake/s
Land
Lndg: Landing, Lndng
Ln: Lane, La
Lgt/s: Light/s
Lf: Loaf
Lck/s: Lock/s
Ldg: Lodge, Ldge, Lodg
Loop: Loops, Lp
Mall
Mnr/s: Manor/s
Mdw/s: Meadow/s
Mdws: Medows
Mews
Ml/s: Mill/s
Msn: Mission, Missn, Mssn
Mtwy: Motorway
Mt: Mount, Mnt
Mtn: Mountain, Mntain, Mntn, Mountin, Mtin
Mnts: Mountains
Nck: Neck
Orch: Orchard, Orchrd
Oval: Ovl
Opas: Overpass
Park: Parks, Prk
Pkwy: Parkway, Parkways, Parkwy, Pkway, Pkwys, Pky, Prkwy
Pass
Psge: Passage
Path: Paths
Pike: Pikes
Pne/s: Pine/s
Pl: Place
Pln/s: Plain/s
Plz: Plaza, Plza
Pt/s: Point/s, Pointe, Pte
Prt/s: Port/s
Pr: Prarie, Prr
Radl: Radial, Rad, Radiel
Ramp
Rnch: Ranch, Ranches, Rnchs
Rpd/s: Rapid/s
Rst: Rest
Rdg/s: Ridge/s, Rdge
Riv: River, Rivr, Rvr
Rd/s: Road/s
Rte: Route
Row
Rue
Run
Shl/s: Shoal/s
Shr/s: Shore/s, Shoar/s
Skwy: Skyway
Spg/s: Spring/s, Spng/s, Sprng/s
Spg: Spr
Spur
Sq/s: Square/s, Sqr, Sqre, Squ
Sta: Station, Statn, Stn
Stra: Stravenue, Strav, Straven, Stravn, Strvn, Strvnue
Strm: Stream, Streme
St/s: Street/s, Str, Strt
Smt: Summit, Sumit, Sumitt
Ter: Terrace, Terr
Trwy: Throughway
Trce: Trace, Traces
Trak: Track, Tracks, Trk, Trks
Trfy: Trafficway
Trl: Trail, Trails, Trls
Trlr: Trailer, Trlrs
Tunl: Tunnel, Tunel, Tunls, Tunnels, Tunnl
Tpke: Turnpike, Trnpk, Turnpk
Upas: Underpass
Un/s: Union/s
Vly/s: Valley/s, Vally, Vlly
Via: Viaduct, Vdct, Viadct
Vw/s: View/s
Vlg/s: Village/s, Vill, Villag, Villg, Villiage
Vl: Ville
Vis: Vista, Vist, Vst, Vsta
Walk: Walks
Wall
Way: Wy
Ways
Wl/s: Well/s
"""

# Types in use beside the postal ones, such as those of the national
# address schema; their names are their codes.
OWN_TYPES = """
Abbey, Access Road, Acres, Airport, Alcove, Alle, Approach, Arch, Arroyo, Avenida, Bahia, Bank, Bay, Bayway, Boardwalk, Bureau of Indian Affairs Highway,
Bureau of Indian Affairs Route, Byway, Calle, Caminito, Camino, Cartway, Cerrada, Channel, Chase, Chemin, Circuit, Circulo, Circus, Close, Cluster, Coast Highway,
Concourse, Connect, Connector, Corridor, Corso, Corta, Corte, County Forest Road, County Highway, County Road, County Route, County State Aid Highway, Cours, Cross,
Crossings, Crossway, Cutoff, Cutting, Dell, Dock, Down, Downs, Draw, Drift, Driveway, Echo, Edge, End, Entrada, Entrance, Entry, Esplanade, Exchange, Exit, Fairway,
Fare, Farm, Farm to Market, Federal-Aid Secondary Highway, Fire Road, Flowage, Flyway, Fordway, Forest Highway, Front, Furlong, Gables, Garth, Gate, Gates, Glade,
Gorge, Grade, Greenway, Harbour, Haul Road, Hayway, Heath, Highlands, Hillway, Horn, Horseshoe, Indian Service Road, Interstate, Interval, J-Turn, Keep, Knob, Lair,
Lateral, Ledge, Line, Lookout, Market, Narrows, National Forest Development Road, Nook, Old County Road, Overlook, Parke, Paseo, Passway, Pathway, Peninsula,
Piazza, Placita, Platz, Prairie, Private Road, Promenade, Quarter, Quay, Ranch to Market, Rancho, Reach, Recreational Road, Retreat, Rise, Round, Runne, Runway,
Rural Route, Skies, Slip, Spurs, State Highway, State Park Road, State Parkway, State Road, State Route, State Secondary, State Spur, Strand, Strasse, Strip,
Taxiway, Terminal, Tern, Thruway, Timber Road, Township Road, Triangle, Truck Trail, Turn, United States Forest Service Road, United States Highway,
United States Route, Vereda, Villa, Waddy, Weeg, Wharf, Woods, Wye, Wynd
"""

# Types that stand before a street name.
PRE_TYPES = """
Ave: Avenue, Av
I-: Interstate Highway, Interstate, I
US Hwy: US Highway, U.S. Highway, U.S. Hwy, US, U.S.
St Hwy: State Highway, State Hwy
Co Hwy: County Highway, County Hwy, CoHw
Co Rd: County Road, County Rd, CoRd
Co Rte: County Route, County Rte, CoRt
Par Rd: Parish Road, Parish Rd, ParR
Rte: Route
R Rte: Rural Route
NF Hwy: National Forest Highway, NFHw
NFD: National Forest Development Road
FS Rd: Forest Service Road, FSRd
For Hwy: Forest Highway, Forest Hwy, ForH
For Rd: Forest Road, Forest Rd, ForR
Farm Rd: Farm Road, Fm Rd, FmRd
F-M Rd: Farm-to-Market Road, Farm to Market Road, Farm-to-Market Rd, Farm to Market Rd
Ranch Rd: Ranch Road
R-M Rd: Ranch to Market Road, Ranch to Market Rd, RMRd
Res Hwy: Reservation Highway, Reservation Hwy, ResH
Sv Rte: Service Route, Service Rte, SvRt
Srv Rd: Service Road, Service Rd, SrvR, Svc Rd
Lg Rd: Logging Road, Logging Rd, LgRd
FR Rd: Fire Road, Fire Rd, FRRd
FR Rte: Fire Route, Fire Rte, FRRt
FR Trl: Fire Trail, Fire Trl, FRTr
Ind Rte: Indian Route, IndR
IndSvRte: Indian Service Route, IndS
NSv Rte: Navajo Service Route, NSvR
IL Rte: Illinois Route, ILRt
NJ Rte: New Jersey Route, NJRt
KS StHwy: Kansas State Highway, KStH
"""

# Directions.
DIRECTIONS = """
N: North, N.
S: South, S.
E: East, E.
W: West, W.
NE: Northeast, North East, North-East, N.E.
NW: Northwest, North West, North-West, N.W.
SE: Southeast, South East, South-East, S.E.
SW: Southwest, South West, South-West, S.W.
"""

# Postal abbreviations of states and territories.
STATES = """
AL: Alabama
AK: Alaska
AZ: Arizona
AR: Arkansas
CA: California
CO: Colorado
CT: Connecticut
DE: Delaware
DC: District of Columbia
FL: Florida
GA: Georgia
HI: Hawaii
ID: Idaho
IL: Illinois
IN: Indiana
IA: Iowa
KS: Kansas
KY: Kentucky
LA: Louisiana
ME: Maine
MD: Maryland
MA: Massachusetts
MI: Michigan
MN: Minnesota
MS: Mississippi
MO: Missouri
MT: Montana
NE: Nebraska
NV: Nevada
NH: New Hampshire
NJ: New Jersey
NM: New Mexico
NY: New York
NC: North Carolina
ND: North Dakota
OH: Ohio
OK: Oklahoma
OR: Oregon
PA: Pennsylvania
RI: Rhode Island
SC: South Carolina
SD: South Dakota
TN: Tennessee
TX: Texas
UT: Utah
VT: Vermont
VA: Virginia
WA: Washington
WV: West Virginia
WI: Wisconsin
WY: Wyoming
AS: American Samoa
GU: Guam
MP: Northern Mariana Islands
PR: Puerto Rico
VI: U.S. Virgin Islands
"""


def entries(text: str) -> dict[str, str]:
    """Lower-case spelling to canonical form. Canonical forms go first, so that
    an alias never hides one."""
    rows: list[tuple[str, list[str]]] = []
    for line in text.strip().splitlines():
        head, _, rest = line.partition(":")
        forms = [head.strip(), *(a.strip() for a in rest.split(",") if a.strip())]
        rows.append((forms[0].removesuffix("/s"), [f.removesuffix("/s") for f in forms[1:]]))
        if forms[0].endswith("/s"):
            rows.append((forms[0].replace("/s", "s"), [f.replace("/s", "s") for f in forms[1:] if f.endswith("/s")]))
    out = {c.lower(): c for c, _ in rows}
    for c, aliases in rows:
        for a in aliases:
            out.setdefault(a.lower(), c)
    return out


_KINDS = {"post_type": POST_TYPES, "pre_type": PRE_TYPES, "direction": DIRECTIONS, "state": STATES}


@lru_cache
def _dictionary(kind: str) -> dict[str, str]:
    out = entries(_KINDS[kind])
    if kind == "post_type":
        for w in OWN_TYPES.replace("\n", " ").split(","):
            out.setdefault(w.strip().lower(), w.strip())
    return out


def dictionary(kind: str, extra: Mapping[str, str] | Iterable[str] | None = None) -> dict[str, str]:
    """The dictionary of a kind (post_type, pre_type, direction, state). ``extra``
    adds spellings, or words that stand for themselves such as the street types
    of a regional schema; it never overrides an entry."""
    out = dict(_dictionary(kind))
    more = extra.items() if isinstance(extra, Mapping) else ((w, w) for w in extra or ())
    for k, v in more:
        out.setdefault(k.strip().lower(), v)
    return out


def strip(c: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def constant_map(words: Mapping[str, str]) -> Column:
    """A dictionary as one constant, however many entries it has."""
    return F.from_json(F.lit(json.dumps(dict(words))), "map<string,string>")


def lookup(c: Column, words: Mapping[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(constant_map(words), F.lower(strip(c))), otherwise)


def map_words(c: Column, kind: str, extra: Mapping[str, str] | Iterable[str] | None = None) -> Column:
    """Canonical form; an unknown word comes back trimmed, NULL and ``""`` stay."""
    return lookup(c, dictionary(kind, extra), strip(c))


def map_post_type(c: Column, extra=None) -> Column:
    """Canonical street type. Several types in a row, such as an avenue that is
    a circle, are a type of their own, by their names in capitals and small letters."""
    words = dictionary("post_type", extra)
    text = strip(c)
    compound = F.when(F.contains(text, F.lit(" ")) & F.forall(F.split(F.lower(text), " +"), lambda w: F.try_element_at(constant_map(words), w).isNotNull()), F.initcap(text))
    return lookup(c, words, F.coalesce(compound, text))


def map_pre_type(c: Column, extra=None) -> Column:
    return map_words(c, "pre_type", extra)


def map_direction(c: Column) -> Column:
    return map_words(c, "direction")


def map_state(c: Column) -> Column:
    """Abbreviation of a state; unlike the other maps an unknown one gives NULL.
    Names written without their spaces are known too."""
    words = dictionary("state")
    words |= {k.replace(" ", ""): v for k, v in words.items()}
    return F.when(strip(c) == "", F.lit("")).otherwise(lookup(c, words, F.lit(None).cast("string")))


def values_sql(words: Mapping[str, str]) -> str:
    """The entries as rows of a SQL VALUES list."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(k)}, {q(v)})" for k, v in words.items())
