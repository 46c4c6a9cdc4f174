"""SQL expressions written once and spelled for Spark or for DuckDB.

Operators compose expressions as text through a dialect.  Spark parses them into
Catalyst expressions, so they run in generated code; DuckDB runs the same
operators for checking.  Patterns are those both regex engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence


class Dialect:
    def q(self, text: str) -> str:
        raise NotImplementedError

    def case(self, *pairs: tuple[str, str], other: str = "''") -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END" if pairs else other

    def lookup(self, x: str, table: Mapping[str, str], other: str) -> str:
        return f"CASE {x} " + " ".join(f"WHEN {self.q(k)} THEN {self.q(v)}" for k, v in table.items()) + f" ELSE {other} END"

    def isin(self, x: str, values: Sequence[str]) -> str:
        return f"({x} IN ({', '.join(map(self.q, values))}))"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {self.q(part)})"

    def any_of(self, x: str, parts: Sequence[str]) -> str:
        """One pattern for all words; none of them holds a sign that patterns give a meaning."""
        return self.has(x, "|".join(parts))

    def first_of(self, x: str, parts: Sequence[str], value: Callable[[str], str] | None = None) -> str:
        """The first of the words that ``x`` contains, else empty."""
        return self.case(*((self.contains(x, p), value(p) if value else self.q(p)) for p in parts))

    def either(self, *values: str) -> str:
        """The first value that is not empty."""
        return f"coalesce({', '.join(f'''nullif({v}, '')''' for v in values)}, '')"

    def joined(self, sep: str, *parts: str) -> str:
        """Parts that are not empty, joined."""
        return f"concat_ws({self.q(sep)}, {', '.join(f'''nullif({p}, '')''' for p in parts)})"

    def steps(self, x: str, steps: Sequence[tuple[str, str]]) -> str:
        for pattern, to in steps:
            x = self.rep(x, pattern, to)
        return x

    def squeeze(self, x: str) -> str:
        return f"trim({self.rep(x, '[ \t\n\r]+', ' ')})"

    def rep(self, x: str, pattern: str, to: str) -> str:
        raise NotImplementedError

    def ext(self, x: str, pattern: str, group: int = 1) -> str:
        return f"coalesce(regexp_extract({x}, {self.q(pattern)}, {group}), '')"

    def ext_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.q(pattern)}, {group})"

    def has(self, x: str, pattern: str) -> str:
        raise NotImplementedError


class Spark(Dialect):
    #: A column that keeps predicates from being moved below a projection, where they would repeat its expressions.
    whole = "monotonically_increasing_id()"

    def fence(self, query: str) -> str:
        return f"({query})"

    no_strings, no_numbers = "CAST(array() AS ARRAY<STRING>)", "CAST(array() AS ARRAY<BIGINT>)"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def ordered(self, value: str, order: str, where: str = "true") -> str:
        """Values of a group in order, each once, where it stands first."""
        return f"array_distinct(transform(array_sort(collect_list(struct({order} AS o, {value} AS v)) FILTER (WHERE {where})), z -> z.v))"

    def candidates(self, x: str) -> str:
        """The candidates that a JSON text lists; none if it is no such text."""
        return f"coalesce(from_json(CASE WHEN {x} LIKE '[%]' THEN {x} END, 'array<struct<uae_assetid:string,uae_assetname:string,score:double,reason:string>>'), array())"

    def parses(self, x: str) -> str:
        return f"(trim(coalesce({x}, '')) = '' OR try_parse_json({x}) IS NOT NULL)"

    def percent(self, x: str) -> str:
        return f"format_string('%.1f%%', CAST({x} AS DOUBLE))"

    def flat(self, lists: str, order: str) -> str:
        """The lists of a group in order, as one."""
        return f"flatten(transform(array_sort(collect_list(struct({order} AS o, {lists} AS v))), z -> z.v))"

    def explode(self, items: str, name: str) -> str:
        return f"LATERAL VIEW explode({items}) lv AS {name}"

    def places(self, x: str) -> str:
        return f"sequence(1, length({x}))"

    def count_if(self, test: str) -> str:
        return f"count_if({test})"

    def mode(self, x: str) -> str:
        return f"mode({x}, true)"

    def first_by(self, x: str, order: str) -> str:
        return f"min_by({x}, {order})"

    def last_by(self, x: str, order: str) -> str:
        return f"max_by({x}, {order})"

    def chain(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def lookup(self, x: str, table: Mapping[str, str], other: str) -> str:
        """A map literal, which Catalyst folds; a chain of branches would fill the generated code."""
        return f"coalesce(map({', '.join(f'{self.q(k)}, {self.q(v)}' for k, v in table.items())})[{x}], {other})"

    def q(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.q(pattern)}, {self.q(to)})"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.q(pattern)})"

    def split(self, x: str) -> str:
        return f"split({x}, ' ')"

    def split_on(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.q(pattern)})"

    def keep(self, items: str, test: Callable[[str], str], name: str = "e") -> str:
        return f"filter({items}, {name} -> {test(name)})"

    def each(self, items: str, fn: Callable[[str], str], name: str = "e") -> str:
        return f"transform({items}, {name} -> {fn(name)})"

    def reverse(self, items: str) -> str:
        return f"reverse({items})"

    def woven(self, outer: str, inner: str) -> str:
        """One text of both lists' items in turn, with blanks around the inner ones."""
        return f"array_join(zip_with({outer}, {inner}, (o, i) -> concat(coalesce(o, ''), ' ', coalesce(i, ''), ' ')), '')"

    def join(self, items: str, sep: str) -> str:
        return f"array_join({items}, {self.q(sep)})"

    def distinct(self, items: str) -> str:
        return f"array_distinct({items})"

    def sort(self, items: str) -> str:
        return f"array_sort({items})"

    def size(self, items: str) -> str:
        return f"size({items})"

    def at(self, items: str, i: int) -> str:
        """The i-th item from 0, null beyond the end."""
        return f"get({items}, {i})"

    def slice(self, items: str, n: int) -> str:
        return f"slice({items}, 1, {n})"

    def top(self, items: str) -> str:
        return f"array_max({items})"

    def words(self, values: Sequence[str]) -> str:
        return f"array({', '.join(map(self.q, values))})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def only(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def append(self, a: str, b: str) -> str:
        return f"concat({a}, array({b}))"

    def integer(self, x: str) -> str:
        return f"try_cast({x} AS BIGINT)"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def path(self, x: str) -> str:
        return f"coalesce(try_parse_url({x}, 'PATH'), '')"


class Duck(Dialect):
    whole = "0"

    def fence(self, query: str) -> str:
        return f"(WITH m AS MATERIALIZED ({query}) SELECT * FROM m)"

    no_strings, no_numbers = "CAST([] AS VARCHAR[])", "CAST([] AS BIGINT[])"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def ordered(self, value: str, order: str, where: str = "true") -> str:
        return f"coalesce({self.distinct(f'list({value} ORDER BY {order}) FILTER (WHERE {where})')}, [])"

    def candidates(self, x: str) -> str:
        return f"CASE WHEN {x} LIKE '[%]' AND json_valid({x}) THEN from_json({x}, '[{{\"uae_assetid\":\"VARCHAR\",\"uae_assetname\":\"VARCHAR\",\"score\":\"DOUBLE\",\"reason\":\"VARCHAR\"}}]') ELSE [] END"

    def parses(self, x: str) -> str:
        return f"(trim(coalesce({x}, '')) = '' OR json_valid({x}))"

    def percent(self, x: str) -> str:
        return f"printf('%.1f%%', CAST({x} AS DOUBLE))"

    def flat(self, lists: str, order: str) -> str:
        return f"flatten(list({lists} ORDER BY {order}))"

    def explode(self, items: str, name: str) -> str:
        return f", unnest({items}) AS lv({name})"

    def places(self, x: str) -> str:
        return f"generate_series(1, length({x}))"

    def count_if(self, test: str) -> str:
        return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"

    def mode(self, x: str) -> str:  # of equally frequent values the least, as in Spark's deterministic form
        return f"list_extract(list_sort(list_transform(list_filter(map_entries(histogram({x})), lambda e: e.value = list_max(map_values(histogram({x})))), lambda e: e.key)), 1)"

    def first_by(self, x: str, order: str) -> str:
        return f"arg_min({x}, {order})"

    def last_by(self, x: str, order: str) -> str:
        return f"arg_max({x}, {order})"

    def chain(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def q(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def rep(self, x: str, pattern: str, to: str) -> str:
        back = to
        for i in range(1, 5):
            back = back.replace(f"${i}", f"\\{i}")
        return f"regexp_replace({x}, {self.q(pattern)}, {self.q(back)}, 'g')"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.q(pattern)})"

    def split(self, x: str) -> str:
        return f"string_split({x}, ' ')"

    def split_on(self, x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {self.q(pattern)})"

    def keep(self, items: str, test: Callable[[str], str], name: str = "e") -> str:
        return f"list_filter({items}, lambda {name}: {test(name)})"

    def each(self, items: str, fn: Callable[[str], str], name: str = "e") -> str:
        return f"list_transform({items}, lambda {name}: {fn(name)})"

    def reverse(self, items: str) -> str:
        return f"list_reverse({items})"

    def woven(self, outer: str, inner: str) -> str:
        return f"array_to_string(list_transform(list_zip({outer}, {inner}), lambda z: concat(coalesce(z[1], ''), ' ', coalesce(z[2], ''), ' ')), '')"

    def join(self, items: str, sep: str) -> str:
        return f"coalesce(array_to_string({items}, {self.q(sep)}), '')"

    def distinct(self, items: str) -> str:  # DuckDB's own does not keep the order
        return f"list_transform(list_filter(list_zip({items}, range(1, len({items}) + 1)), lambda z: list_position({items}, z[1]) = z[2]), lambda z: z[1])"

    def sort(self, items: str) -> str:
        return f"list_sort({items})"

    def size(self, items: str) -> str:
        return f"len({items})"

    def at(self, items: str, i: int) -> str:
        return f"({items})[{i + 1}]"

    def slice(self, items: str, n: int) -> str:
        return f"({items})[1:{n}]"

    def top(self, items: str) -> str:
        return f"list_max({items})"

    def words(self, values: Sequence[str]) -> str:
        return f"[{', '.join(map(self.q, values))}]"

    def both(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda e: list_contains({b}, e))"

    def only(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda e: NOT list_contains({b}, e))"

    def append(self, a: str, b: str) -> str:
        return f"list_append({a}, {b})"

    def integer(self, x: str) -> str:
        return f"TRY_CAST({x} AS BIGINT)"

    def number(self, x: str) -> str:
        return f"TRY_CAST({x} AS DOUBLE)"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"

    def path(self, x: str) -> str:
        return f"regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


SPARK, DUCK = Spark(), Duck()
