"""Parts of DuckDB SQL shared by the counterparts of the queries."""

from __future__ import annotations

WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Letters as Java's IsAlphabetic has them in the scripts at hand: letters, letter numbers and vowel signs.
ALPHA = (
    r"\p{L}\p{Nl}\x{345}\x{363}-\x{36f}\x{5b0}-\x{5bd}\x{610}-\x{61a}\x{64b}-\x{657}\x{659}-\x{65f}\x{670}\x{6d6}-\x{6dc}\x{6e1}-\x{6e4}"
    r"\x{900}-\x{903}\x{93a}\x{93b}\x{93e}-\x{94c}\x{94e}\x{94f}\x{955}-\x{957}\x{962}\x{963}\x{e31}\x{e34}-\x{e3a}\x{e4d}\x{24b6}-\x{24e9}"
)
PAGES = "(SELECT * FROM text_pages QUALIFY row_number() OVER (PARTITION BY document_id, page ORDER BY ingested_at DESC NULLS LAST, page_key DESC) = 1)"
ITEMS = "(SELECT * FROM text_items QUALIFY row_number() OVER (PARTITION BY document_id, page, item_no ORDER BY ingested_at DESC NULLS LAST, item_key DESC) = 1)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def u16(x: str) -> str:
    return rf"CAST(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS INTEGER)"


def chars(x: str) -> str:
    return f"CAST(length({x}) AS INTEGER)"


def sentences(source: str, text: str, keys: str, keep: str = "", closers: bool = True, unit=u16) -> str:
    """A subquery: keys, keep, sent_no, text, start, "end"."""
    ends = """([.!?][''"’”)\\]]*)""" if closers else "([.!?])"
    keep = f", {keep}" if keep else ""
    return rf"""(
      WITH cut AS (SELECT {keys}{keep}, string_split(regexp_replace({text}, '{ends}([{WS}])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM {source} WHERE {text} IS NOT NULL),
      each AS (SELECT {keys}{keep}, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM cut),
      run AS (SELECT *, coalesce(sum({unit('piece')}) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM each),
      kept AS (SELECT {keys}{keep}, i, {trim('piece')} AS text, CAST(before + {unit('piece')} - {unit(f"regexp_replace(piece, '^[{WS}]+', '')")} AS INTEGER) AS start FROM run WHERE {trim('piece')} <> '')
      SELECT {keys}{keep}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) AS INTEGER) AS sent_no, text, start, start + {unit('text')} AS "end" FROM kept)"""


def word_form(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^{ALPHA}\p{{N}}]+', ' ', 'g'))"


def policy_form(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^{ALPHA}\p{{N}}%<>]+', ' ', 'g'))"


def match_form(x: str) -> str:
    """Lower case, hyphenated line ends joined, ASCII letters and digits. RE2 has no lookahead, so the letter behind is put back."""
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '([a-z])-[\t-\r \x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+([a-z])', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def words(form: str) -> str:
    return f"list_filter(string_split({form}, ' '), lambda w: w <> '')"


def meaningful(form: str) -> str:
    return f"list_filter(string_split({form}, ' '), lambda w: length(w) > 2)"


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
