"""Parts of SQL for DuckDB that stand for Unicode rules it lacks, made from the rules themselves."""

from __future__ import annotations

from functools import lru_cache

from folioforge.functions.text import COMPOUND_NAMES, NO_PLACE_MARKERS, STATES, decompositions

#: White space of any kind.
S = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    """Without white space at the ends."""
    return f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str, str]:
    single, dropped, several = decompositions()
    source, target = "".join(single) + "".join(dropped), "".join(single.values())
    pairs = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in several.items())
    return quoted(source), quoted(target), "[" + "".join(several) + "]", "MAP {" + pairs + "}"


def decomposed(c: str) -> str:
    """Compatibility decomposition without combining marks."""
    source, target, several, names = _tables()
    wide = f"CASE WHEN regexp_matches({c}, {quoted(several)}) THEN array_to_string(list_transform(string_split({c}, ''), lambda ch: coalesce({names}[ch], ch)), '') ELSE {c} END"
    return f"translate({wide}, {source}, {target})"


def cleaned(c: str) -> str:
    """Letters in lower case and single spaces."""
    return f"trim(lower(regexp_replace({decomposed(c)}, '[^\\p{{L}}]+', ' ', 'g')))"


def ascii_key(c: str) -> str:
    """ASCII only, lower case, single spaces."""
    return f"lower(trim(regexp_replace(regexp_replace({decomposed(c)}, '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')))"


def states() -> str:
    """Rows ``name, code`` of the spellings of the states."""
    plain = lambda text: " ".join("".join(x if x.isalpha() else " " for x in text.lower()).split())
    rows = dict.fromkeys((plain(s), code.lower()) for code, spellings in STATES.items() for s in [*spellings, code])
    return "(VALUES " + ", ".join(f"({quoted(n)}, {quoted(c)})" for n, c in rows) + ") states(name, code)"


def canonical(values: str, place: str, regions: str) -> str:
    """Query ``place, canonical`` of the rows of ``values``: cut at the last state, or region, of up to three words."""
    markers = ", ".join(map(quoted, NO_PLACE_MARKERS))
    return f"""SELECT d.{place}, CASE WHEN t IS NULL OR t = '' OR t IN ({markers}) THEN NULL WHEN h.code IS NULL THEN t ELSE trim(array_to_string(w[1 : j - 1], ' ') || ' ' || h.code) END AS canonical
FROM (SELECT {place}, {strip(place)} AS t, string_split({strip(place)}, ' ') AS w FROM ({values})) d
LEFT JOIN (SELECT {place}, j, r.code, row_number() OVER (PARTITION BY {place} ORDER BY j DESC, n DESC) AS k
  FROM (SELECT *, unnest([1, 2, 3]) AS n FROM (SELECT {place}, w, unnest(range(1, len(w) + 1)) AS j FROM (SELECT {place}, string_split({strip(place)}, ' ') AS w FROM ({values}))))
  JOIN (SELECT * FROM {regions}) r ON r.name = array_to_string(w[j : j + n - 1], ' ')
  WHERE j + n - 1 <= len(w) AND NOT (j = 1 AND len(w) > 1 AND w[1] = 'mt')) h ON h.{place} = d.{place} AND k = 1"""


def _guarded(c: str) -> str:
    """Conjunctions inside compound names as private characters."""
    out = c
    for name in COMPOUND_NAMES:
        words = name.split()
        at = words.index("and")
        left, right = (f"{S}+".join(w.replace("st", "st\\.?") if w == "st" else w for w in part) for part in (words[:at], words[at + 1 :]))
        for word, mark in (("and", ""), ("&", "")):
            out = f"regexp_replace({out}, '(?i)\\b({left}{S}+){word}({S}+{right})\\b', '\\1{mark}\\2', 'g')"
    return out


def places(rows: str) -> str:
    """Common tables that end in ``places(rec_id, pos, place)`` from ``rows(rec_id, places)``: lists split at top level, each place once."""
    separator = f"(?i){S}*;{S}*|{S}*&{S}*|{S}+and{S}+"
    first = f"regexp_replace({strip('raw')}, '(?i)^(and|&){S}+', '')"
    return f"""given AS (SELECT rec_id, CASE WHEN len(places) > 0 THEN places ELSE [NULL] END AS l FROM ({rows})),
elements AS (SELECT rec_id, unnest(l) AS raw, generate_subscripts(l, 1) AS e FROM given),
texts AS (SELECT rec_id, e, {strip(first)} AS text FROM elements),
inner_ AS (SELECT *, {_guarded(f"CASE WHEN starts_with(text, '[') AND ends_with(text, ']') THEN {strip('text[2:-2]')} ELSE text END")} AS body FROM texts WHERE coalesce(text, '') <> ''),
cut AS (SELECT *, string_split_regex(body, {quoted(separator)}) AS parts, regexp_extract_all(body, {quoted(separator)}) AS joints FROM inner_),
deep AS (SELECT *, list_transform(range(1, len(parts)), lambda k: list_reduce(list_prepend(0, list_transform(regexp_extract_all(array_to_string(parts[1:k], ''), '[(){{}}]'),
  lambda m: CASE WHEN m IN ('(', '{{') THEN 1 ELSE -1 END)), lambda a, x: greatest(0, a + x))) AS depth FROM cut),
bits AS (SELECT rec_id, e, text, parts, joints, depth, unnest(range(1, len(parts) + 1)) AS i FROM deep),
marked AS (SELECT *, sum(CASE WHEN i > 1 AND depth[i - 1] = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, e ORDER BY i) AS piece FROM bits),
pieces AS (SELECT rec_id, e, piece, any_value(text) AS text, string_agg(parts[i] || CASE WHEN i < len(parts) AND depth[i] > 0 THEN joints[i] ELSE '' END, '' ORDER BY i) AS p FROM marked GROUP BY 1, 2, 3),
whole AS (SELECT *, count(*) OVER (PARTITION BY rec_id, e) AS n FROM pieces),
kept AS (SELECT rec_id, e, piece, CASE WHEN n = 1 THEN text ELSE {strip("replace(replace(p, chr(57345), 'and'), chr(57346), '&')")} END AS place FROM whole),
good AS (SELECT * FROM kept WHERE place <> ''),
every AS (SELECT * FROM good UNION ALL SELECT rec_id, e, 0, NULL FROM texts WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.rec_id = texts.rec_id AND g.e = texts.e)),
once AS (SELECT rec_id, place, e, piece FROM every QUALIFY row_number() OVER (PARTITION BY rec_id, place ORDER BY e, piece) = 1),
places AS (SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY e, piece) - 1 AS INT) AS pos, place FROM once)"""
