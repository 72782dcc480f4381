"""Syntax trees to DataFrame plans: patterns become equi-joins, existence becomes semi joins, and the rest is left to Catalyst.

A variable of a node or relationship is a group of flat columns (`a$id`, `a$name`, ...), so column
pruning and predicate pushdown reach the scans; a struct is built only where a whole entity is returned.
A node at a relationship's end is its id alone until a property or label of it is asked for: only then
is its table joined.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, CypherSyntaxError, CypherTypeError, EntityNotFound, ParameterMissing, ProcedureError
from ..functions import scalar, temporal
from ..lang.parser import UPDATES, parse
from ..sources.graph import PropertyGraph
from ..sources.held import held
from .updates import Updates


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def conjuncts(e) -> list:
    return conjuncts(e[2]) + conjuncts(e[3]) if e and e[0] == "bin" and e[1] == "and" else [e] if e else []


def has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        return e[:1] == ("agg",) or (e[:1] != ("existsq",) and any(has_aggregate(x) for x in e))
    return isinstance(e, list) and any(has_aggregate(x) for x in e)


def references(e, out: set | None = None) -> set[tuple[str, str | None]]:
    """(variable, property) pairs that a tree mentions; property None for a variable as a whole."""
    out = set() if out is None else out
    if isinstance(e, tuple) and e:
        if e[0] == "prop" and e[1][0] == "var":
            out.add((e[1][1], e[2]))
            return out
        if e[0] == "var":
            out.add((e[1], None))
        if e[0] == "haslabels":
            out.add((e[1], "labels"))
        if e[0] == "node":
            out.add((e[1], "id"))
            if e[2]:
                out.add((e[1], "labels"))
            out.update((e[1], k) for k, _ in e[3])
        if e[0] == "rel":
            out.add((e[1], "id"))
    if isinstance(e, (tuple, list)):
        for x in e:
            references(x, out)
    return out


def whole(e, out: set[str] | None = None) -> set[str]:
    """Variables of paths and relationship lists of which more than the length is asked for; `*` for all."""
    out = set() if out is None else out
    if isinstance(e, tuple) and e:
        if e[0] == "call" and e[1] in ("length", "size") and e[2]:
            inner = e[2][0]
            if inner[0] == "var" or (inner[0] == "call" and inner[1] in ("nodes", "relationships") and inner[2][0][0] == "var"):
                return out
        if e[0] == "var":
            out.add(e[1])
        if e[0] in ("with", "return") and len(e) == 6 and e[2]:
            out.add("*")
    if isinstance(e, (tuple, list)):
        for x in e:
            whole(x, out)
    return out


def class_of(t: T.DataType) -> str:
    """Values of different classes are never equal and have no order."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.NumericType):
        return "number"
    return temporal.kind_of(t) or {T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "list", T.StructType: "map", T.MapType: "map"}.get(type(t), t.simpleString())


def equal(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """Equality of three values: null if an operand, or a member that decides, is null; NaN equals nothing."""
    kinds = class_of(ta), class_of(tb)
    if "null" in kinds:
        return F.lit(None).cast("boolean")
    if kinds[0] != kinds[1]:
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
    if kinds[0] == "list":
        members = F.zip_with(a, b, lambda x, y: equal(x, y, ta.elementType, tb.elementType))
        return F.when(F.size(a) != F.size(b), F.lit(False)).otherwise(F.forall(members, lambda x: x))
    if kinds[0] == "duration":
        return a == b
    if kinds[0] in temporal.KINDS:
        return temporal.sort_key(a, ta) == temporal.sort_key(b, tb)
    if kinds[0] == "map" and isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
        if "id" in ta.names and "id" in tb.names and {"labels", "start"} & set(ta.names):
            return a["id"] == b["id"]
        if set(ta.names) != set(tb.names):
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
        fields = [equal(a[n], b[n], ta[n].dataType, tb[n].dataType) for n in ta.names]
        return F.when(a.isNotNull() & b.isNotNull(), reduce(lambda x, y: x & y, fields, F.lit(True)))
    nan = [F.isnan(x) for x, t in ((a, ta), (b, tb)) if isinstance(t, (T.DoubleType, T.FloatType))]
    return (a == b) & ~reduce(lambda x, y: x | y, nan) if nan else a == b


def ordered(op: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    kind = class_of(ta)
    if kind != class_of(tb) or kind in ("map", "duration"):
        return F.lit(None).cast("boolean")
    nan = [F.isnan(x) for x, t in ((a, ta), (b, tb)) if isinstance(t, (T.DoubleType, T.FloatType))]
    if kind in temporal.KINDS:
        a, b = temporal.sort_key(a, ta), temporal.sort_key(b, tb)
    out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return out & ~reduce(lambda x, y: x | y, nan) if nan else out


class Plan(Updates):
    """Rows so far (df) and what each variable is: ("node" | "rel", columns), ("value",), ("path", elements) ...

    A node that is only an id so far is ("node", ["id"], possible labels); see `complete`. `carry` names columns
    that every projection keeps: the outer keys of a subquery.
    """

    def __init__(self, graph: PropertyGraph, spark: SparkSession, params: dict, df: DataFrame | None = None, env: dict | None = None, asked: set | None = None, carry: tuple = ()):
        self.graph, self.spark, self.params, self.df, self.env, self.names = graph, spark, params, df, env or {}, 0
        self.asked, self.carry = asked or set(), carry

    def fork(self, df: DataFrame | None, env: dict, carry: tuple = ()) -> Plan:
        out = Plan(self.graph, self.spark, self.params, df, env, self.asked, carry)
        out.names = self.names + 1000
        return out

    def one(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(0).alias("#unit"))

    def fresh(self) -> str:
        self.names += 1
        return f"#x{self.names}"

    def kind(self, var: str) -> str:
        return self.env.get(var, ("",))[0]

    def columns_of(self, var: str) -> list[str]:
        kind = self.env[var]
        return [f"{var}${c}" for c in kind[1]] if kind[0] in ("node", "rel", "gone") else [var] if kind[0] in ("value", "relist") else []

    def complete(self, var: str) -> None:
        """Join the table of a node that is only an id so far."""
        if self.kind(var) == "gone":
            raise EntityNotFound("DeletedEntityAccess", var)
        if self.kind(var) == "node" and len(self.env[var]) == 3:
            table = self.graph.node_table(self.env[var][2])
            if table is None:
                table = self.spark.createDataFrame([], "id long, labels array<string>")
            columns = [c for c in table.columns if c != "id"]
            hold = self.fresh()
            table = table.select(col("id").alias(hold), *[col(c).alias(f"{var}${c}") for c in columns])
            self.df = self.df.join(table, col(f"{var}$id") == col(hold), "left").drop(hold)
            self.env[var] = ("node", ["id", *columns])

    # -- expressions ---------------------------------------------------------------------------

    def type_of(self, c: Column) -> T.DataType:
        return (self.df if self.df is not None else self.one()).select(c.alias("t")).schema[0].dataType

    def type_at(self, e, c: Column, local: dict) -> T.DataType:
        """Type of the tree e, compiled to c. Where c depends on lambda variables, a member of the list stands for each."""
        return self.type_of(self.expr(e, {v: (s, s) for v, (_, s) in local.items()}) if any(x is not s for x, s in local.values()) else c)

    def typed(self, e, local: dict) -> tuple[Column, T.DataType]:
        c = self.expr(e, local)
        return c, self.type_at(e, c, local)

    def entity(self, var: str) -> Column:
        if self.kind(var) in ("node", "rel", "gone"):
            self.complete(var)
            return F.when(col(f"{var}$id").isNotNull(), F.struct(*[col(f"{var}${c}").alias(c) for c in self.env[var][1]]))
        if self.kind(var) == "path":
            return F.struct(self.path_part(var, "node").alias("nodes"), self.path_part(var, "rel").alias("relationships"))
        return col(var)

    def path_size(self, var: str, what: str) -> Column:
        steps = reduce(lambda a, b: a + b, [F.size(v) if k == "relist" else F.when(col(f"{v}$id").isNotNull(), 1) for k, v in self.env[var][1] if k != "node"], F.lit(0))
        return (steps + int(what == "node")).cast("long")

    def path_part(self, var: str, what: str) -> Column:
        """A path's nodes or relationships: a list of entities with all their properties."""
        parts = []
        for element, own in self.env[var][1]:
            if element == what:
                parts.append(F.array(self.entity(own)))
            elif element == "relist":
                parts.append(col(own) if what == "rel" else col(f"{own}$between"))
        if not parts:
            return F.array()
        types = [self.type_of(p).elementType for p in parts]
        fields: dict[str, T.DataType] = {}
        for t in types:
            for f in t.fields:
                fields[f.name] = f.dataType if fields.get(f.name, f.dataType) == f.dataType or isinstance(fields[f.name], T.NullType) else T.StringType()

        def alike(p: Column, t: T.StructType) -> Column:
            return F.transform(p, lambda x: F.when(x.isNotNull(), F.struct(*[(x[n] if n in t.names else F.lit(None)).cast(k).alias(n) for n, k in fields.items()])))

        return F.concat(*[alike(p, t) for p, t in zip(parts, types, strict=True)])

    def endpoint(self, var: str, which: str) -> str:
        """The variable of a relationship's start or end node."""
        name = f"#{which}${var}"
        if name not in self.env:
            self.df = self.df.withColumn(f"{name}$id", col(f"{var}${which}"))
            self.env[name] = ("node", ["id"], None)
        return name

    def expr(self, e, local: dict | None = None) -> Column:
        local = local or {}
        go = lambda x: self.expr(x, local)
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1]).cast("long") if type(e[1]) is int else F.lit(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise ParameterMissing("MissingParameter", e[1])
            return F.lit(self.params[e[1]])
        if kind == "column":
            return col(e[1])
        if kind == "var":
            if e[1] in local:
                return local[e[1]][0]
            if e[1] not in self.env:
                raise CypherSyntaxError("UndefinedVariable", e[1])
            return self.entity(e[1])
        if kind == "prop":
            return self.property(e, local)
        if kind == "bin":
            return self.binary(e[1], e[2], e[3], local)
        if kind == "not":
            return ~self.boolean(e[1], local)
        if kind == "neg":
            return -go(e[1])
        if kind == "isnull":
            x = col(f"{e[1][1]}$id") if e[1][0] == "var" and self.kind(e[1][1]) in ("node", "rel") and e[1][1] not in local else go(e[1])
            return x.isNotNull() if e[2] else x.isNull()
        if kind == "list":
            return F.array(*[go(x) for x in e[1]])
        if kind == "map":
            return F.struct(*[go(x).alias(k) for k, x in e[1]])
        if kind == "index":
            (x, t), i = self.typed(e[1], local), go(e[2])
            if scalar.is_list(t):
                return F.when(i >= 0, F.get(x, i.cast("int")))
            if isinstance(t, T.NullType):
                return F.lit(None)
            name = e[2][1] if e[2][0] == "lit" else self.params.get(e[2][1]) if e[2][0] == "param" else None
            if isinstance(name, str):
                return self.property(("prop", e[1], name), local)
            raise CypherTypeError("InvalidArgumentType", "index")
        if kind == "slice":
            x, t = self.typed(e[1], local)
            return scalar.slice_of(x, t, e[2] and go(e[2]), e[3] and go(e[3]))
        if kind == "case":
            out = None
            for test, value in e[2]:
                cond = go(test) if e[1] is None else self.binary("=", e[1], test, local)
                out = F.when(cond, go(value)) if out is None else out.when(cond, go(value))
            return out.otherwise(go(e[3])) if e[3] else out
        if kind == "comp":
            source, within = self.members(e[1], e[2], local)
            if e[3]:
                source = F.filter(source, lambda x: self.expr(e[3], within(x)))
            return F.transform(source, lambda x: self.expr(e[4], within(x))) if e[4] else source
        if kind == "quant":
            source, within = self.members(e[2], e[3], local)
            test = lambda x: self.expr(e[4], within(x))
            if e[1] == "all":
                return F.forall(source, test)
            if e[1] == "single":
                found, unknown = F.size(F.filter(source, test)), F.size(F.filter(source, lambda x: test(x).isNull()))
                return F.when(source.isNull(), F.lit(None)).when(found > 1, F.lit(False)).when(unknown == 0, found == 1)
            return F.exists(source, test) if e[1] == "any" else ~F.exists(source, test)
        if kind == "haslabels":
            if self.kind(e[1]) == "rel":
                return reduce(lambda a, b: a & b, [col(f"{e[1]}$type") == x for x in e[2]])
            if e[1] not in self.env:
                raise CypherSyntaxError("UndefinedVariable", e[1])
            self.complete(e[1])
            return reduce(lambda a, b: a & b, [F.array_contains(col(f"{e[1]}$labels"), x) for x in e[2]])
        if kind in ("exists", "existsq"):
            return self.flag(e)
        if kind == "pcomp":
            return self.pattern_comprehension(e)
        if kind == "call":
            return self.call(e[1], e[2], local)
        if kind == "agg":
            raise CypherSyntaxError("InvalidAggregation", "an aggregate has no place here")
        raise CypherSyntaxError("UnexpectedSyntax", kind)

    def members(self, var: str, e, local: dict):
        """A list, and the scope in which var is one of its members."""
        source, t = self.typed(e, local)
        if isinstance(t, T.NullType):
            source = F.lit(None).cast("array<void>")
        elif not scalar.is_list(t):
            raise CypherTypeError("InvalidArgumentType", f"{t.simpleString()} is no list")
        sampled = self.expr(e, {v: (s, s) for v, (_, s) in local.items()}) if local else source
        sample = F.get(sampled, F.lit(0))
        return source, lambda x: local | {var: (x, sample)}

    def property(self, e, local) -> Column:
        base, name = e[1], e[2]
        if base[0] == "call" and base[1] in ("startnode", "endnode") and base[2][0][0] == "var" and self.kind(base[2][0][1]) == "rel" and base[2][0][1] not in local:
            base = ("var", self.endpoint(base[2][0][1], base[1].removesuffix("node")))
        if base[0] == "var" and base[1] not in local:
            if base[1] not in self.env:
                raise CypherSyntaxError("UndefinedVariable", base[1])
            if self.kind(base[1]) in ("node", "rel", "gone"):
                self.complete(base[1])
                return col(f"{base[1]}${name}") if name in self.env[base[1]][1] and name not in ("id", "labels", "start", "end") and not (name == "type" and self.kind(base[1]) == "rel") else F.lit(None)
            if self.kind(base[1]) == "path":
                raise CypherTypeError("InvalidArgumentType", f"{name} of a path")
        x, t = self.typed(base, local)
        if temporal.kind_of(t):
            return temporal.component(x, t, name)
        if isinstance(t, T.StructType):
            return x[name] if name in t.names else F.lit(None)
        if isinstance(t, T.MapType):
            return F.try_element_at(x, F.lit(name))
        if isinstance(t, T.NullType):
            return F.lit(None)
        raise CypherTypeError("InvalidArgumentType", f"{name} of {t.simpleString()}")

    def boolean(self, e, local) -> Column:
        c = self.expr(e, local)
        if e[0] == "lit" and not isinstance(e[1], (bool, type(None))):
            raise CypherTypeError("InvalidArgumentType", f"{e[1]!r} is no boolean")
        return c

    def binary(self, op: str, left, right, local) -> Column:
        if op in ("and", "or", "xor"):
            a, b = self.boolean(left, local), self.boolean(right, local)
            return a & b if op == "and" else a | b if op == "or" else a != b
        if op in ("=", "<>") and all(x[0] == "var" and x[1] not in local and self.kind(x[1]) in ("node", "rel") for x in (left, right)):
            same = col(f"{left[1]}$id") == col(f"{right[1]}$id")
            if self.kind(left[1]) == self.kind(right[1]) == "rel":
                same = same & (col(f"{left[1]}$type") == col(f"{right[1]}$type"))
            return same if op == "=" else ~same
        if op == "=~":
            raise CypherSyntaxError("UnexpectedSyntax", "=~ is not supported")
        (a, ta), (b, tb) = self.typed(left, local), self.typed(right, local)
        if op in ("=", "<>"):
            same = equal(a, b, ta, tb)
            return same if op == "=" else ~same
        if op in ("<", "<=", ">", ">="):
            return ordered(op, a, b, ta, tb)
        if op == "in":
            if isinstance(tb, T.NullType):
                return F.lit(None).cast("boolean")
            if not scalar.is_list(tb):
                raise CypherTypeError("InvalidArgumentType", "IN needs a list")
            if isinstance(ta, T.NullType) or isinstance(tb.elementType, T.NullType):
                return F.when(F.size(b) == 0, F.lit(False))
            plain = class_of(ta) == class_of(tb.elementType) and class_of(ta) in ("number", "string", "boolean", "date", "localdatetime")
            found = F.array_contains(b, a) if plain else F.exists(b, lambda x: equal(x, a, tb.elementType, ta))
            return F.when(F.size(b) == 0, F.lit(False)).otherwise(found)
        if op in ("starts", "ends", "contains"):
            if not (isinstance(ta, T.StringType) and isinstance(tb, T.StringType)):
                return F.lit(None).cast("boolean")
            return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op](a, b)
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        kinds = class_of(ta), class_of(tb)
        if op == "+":
            if "list" in kinds:
                one = lambda x, t: x if scalar.is_list(t) else F.array(x)
                return F.when(b.isNotNull() if kinds[0] == "list" == kinds[1] else F.lit(True), F.concat(one(a, ta), one(b, tb)))
            if "string" in kinds and "null" not in kinds:
                return F.concat(scalar.to_string(a, ta), scalar.to_string(b, tb))
        if "duration" in kinds:
            return self.with_duration(op, a, b, ta, tb)
        if "null" in kinds:
            return F.lit(None)
        if kinds != ("number", "number"):
            raise CypherTypeError("InvalidArgumentType", f"{kinds[0]} {op} {kinds[1]}")
        if op in "+-*":
            return {"+": a + b, "-": a - b, "*": a * b}[op]
        whole = isinstance(ta, scalar.INTEGRAL) and isinstance(tb, scalar.INTEGRAL)
        zero = F.lit(0).cast("long") if whole else F.lit(0.0)
        if op == "%":
            return a % F.nullif(b, zero)
        if whole:
            return F.call_function("div", a, F.nullif(b, zero))
        a, b = a.cast("double"), b.cast("double")
        at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(b == 0, F.when(a.isNotNull(), at_zero)).otherwise(a / F.nullif(b, F.lit(0.0)))

    def with_duration(self, op: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
        kinds = class_of(ta), class_of(tb)
        if "null" in kinds:
            return F.lit(None)
        if op in "+-" and kinds[1] == "duration" and kinds[0] in temporal.KINDS:
            return temporal.plus(a, ta, b, 1 if op == "+" else -1)
        if op == "+" and kinds[1] in temporal.KINDS:
            return temporal.plus(b, tb, a)
        if op in "*/" and kinds == ("duration", "number"):
            return temporal.scale(a, b, tb, op == "/")
        if op == "*" and kinds == ("number", "duration"):
            return temporal.scale(b, a, ta)
        raise CypherTypeError("InvalidArgumentType", f"{kinds[0]} {op} {kinds[1]}")

    def call(self, name: str, args, local) -> Column:
        if args and args[0][0] == "var" and args[0][1] in self.env and args[0][1] not in local:
            var, kind = args[0][1], self.env[args[0][1]]
            if kind[0] in ("node", "rel", "gone"):
                if name == "id":
                    return col(f"{var}$id")
                if name == "type" and kind[0] != "node":
                    return col(f"{var}$type")
                if (name, kind[0]) in (("type", "node"), ("labels", "rel")):
                    raise CypherSyntaxError("InvalidArgumentType", f"{name} of a {kind[0]}")
                self.complete(var)
                if name == "labels":
                    return col(f"{var}$labels")
                if name in ("keys", "properties"):
                    own = [c for c in self.env[var][1] if c not in ("id", "labels", "start", "end", "type" if kind[0] == "rel" else "")]
                    if name == "properties":
                        return F.struct(*[col(f"{var}${c}").alias(c) for c in own])
                    return F.sort_array(F.filter(F.array(*[F.when(col(f"{var}${c}").isNotNull(), F.lit(c)) for c in own]).cast("array<string>"), lambda x: x.isNotNull()))
                if name in ("startnode", "endnode") and kind[0] == "rel":
                    return self.entity(self.endpoint(var, name.removesuffix("node")))
            if kind[0] == "path":
                if name == "length":
                    return self.path_size(var, "rel")
                if name in ("nodes", "relationships"):
                    return self.path_part(var, "node" if name == "nodes" else "rel")
        if name == "size" and args and args[0][0] == "call" and args[0][1] in ("nodes", "relationships") and args[0][2][0][0] == "var" and self.kind(args[0][2][0][1]) == "path":
            return self.path_size(args[0][2][0][1], "node" if args[0][1] == "nodes" else "rel")
        if name == "size" and args and args[0][0] == "pcomp":
            return self.pattern_comprehension(args[0], counted=True)
        if name.partition(".")[0] in temporal.KINDS or name in temporal.CURRENT:
            own, unit, fields = list(args), None, None
            if name.endswith(".truncate"):
                if own[0][0] != "lit":
                    raise CypherTypeError("InvalidArgumentType", "truncate takes a literal unit")
                unit = own.pop(0)[1]
            if own and own[-1][0] == "map" and (unit or len(own) == 1):
                fields = {k: self.typed(x, local) for k, x in own.pop()[1]}
            found = temporal.call(name, [self.typed(x, local) for x in own], fields, unit)
            if found is None:
                raise CypherSyntaxError("UnknownFunction", name)
            return found
        found = [self.typed(x, local) for x in args]
        if found and name in ("labels", "type", "id", "keys", "properties", "startnode", "endnode") and isinstance(found[0][1], T.StructType):
            return self.of_entity(name, *found[0])
        if name == "tostring" and temporal.kind_of(found[0][1]):
            return temporal.text(*found[0])
        try:
            return scalar.call(name, [c for c, _ in found], [t for _, t in found])
        except (IndexError, TypeError) as e:
            raise CypherSyntaxError("InvalidNumberOfArguments", f"{name} of {len(found)}") from e

    def of_entity(self, name: str, x: Column, t: T.StructType) -> Column:
        """Functions of an entity that a list or map held."""
        own = [c for c in t.names if not ({"labels", "start"} & set(t.names) and c in ("id", "labels", "start", "end") or ("start" in t.names and c == "type"))]
        if name == "properties":
            return F.when(x.isNotNull(), F.struct(*[x[c].alias(c) for c in own]))
        if name == "keys":
            return F.when(x.isNotNull(), F.sort_array(F.filter(F.array(*[F.when(x[c].isNotNull(), F.lit(c)) for c in own]).cast("array<string>"), lambda c: c.isNotNull())))
        field = {"startnode": "start", "endnode": "end"}.get(name, name)
        if field not in t.names:
            raise CypherTypeError("InvalidArgumentType", f"{name} of {t.simpleString()}")
        return F.struct(x[field].alias("id")) if field in ("start", "end") else x[field]

    # -- subqueries -----------------------------------------------------------------------------

    def outer(self, e, more: set[str] = frozenset()) -> tuple[Plan, list[str]]:
        """A plan over the distinct outer columns that a subquery mentions."""
        env, keys = {}, []
        for var, prop in sorted(references(e), key=str):
            if var not in self.env:
                continue
            if self.kind(var) == "node" and len(self.env[var]) == 3 and prop != "id":
                self.complete(var)
            kind = self.env[var]
            if kind[0] in ("node", "rel"):
                wanted = ["id"] + (["labels"] if prop == "labels" else [prop] if prop and prop in kind[1] and prop != "id" else [c for c in kind[1] if c != "id"] if prop is None else [])
                wanted += ["type", "start", "end"] if kind[0] == "rel" else []
                held_ = env.setdefault(var, (kind[0], [], *kind[2:]))[1]
                held_ += [c for c in wanted if c not in held_ and c in kind[1]]
            else:
                env[var] = kind
        env = {v: k if k[0] not in ("node", "rel") or set(k[1]) != {"id"} else (k[0], ["id"], k[2] if len(k) == 3 else None) for v, k in env.items()}
        sub = self.fork(None, env)
        for var in env:
            keys += sub.columns_of(var)
        if keys:
            sub.df = self.df.select(*[col(c) for c in keys]).distinct()
        return sub, keys

    def attach(self, keys: list[str], found: DataFrame, how: str) -> DataFrame:
        """Join found (keys and more) to the rows on equal keys, nulls included."""
        if not keys:
            return self.df.join(found, how=how)
        renamed = found.select(*[col(c).alias(f"{c}#k") if c in keys else col(c) for c in found.columns])
        on = reduce(lambda a, b: a & b, [col(c).eqNullSafe(col(f"{c}#k")) if not c.endswith("$id") else col(c) == col(f"{c}#k") for c in keys])
        out = self.df.join(renamed, on, how)
        return out.drop(*[f"{c}#k" for c in keys]) if how not in ("left_semi", "left_anti") else out

    def existing(self, e) -> tuple[DataFrame, list[str]]:
        sub, keys = self.outer(e)
        if e[0] == "exists":
            sub.match(e[1], e[2], False)
            return (sub.df.select(*[col(c) for c in keys]).distinct() if keys else sub.df.select(F.lit(1).alias("#hit")).limit(1)), keys
        # whole clauses: projections keep copies of the outer keys
        copies = [f"#o{k}${sub.names}" for k in range(len(keys))]
        if keys:
            sub.df = sub.df.select("*", *[col(c).alias(n) for c, n in zip(keys, copies, strict=True)])
        sub.carry = tuple(copies)
        if e[1][-1][0] == "return":
            sub.run(e[1])
        else:
            for c in e[1]:
                sub.clause(c)
        found = sub.df
        return (found.select(*[col(n).alias(c) for c, n in zip(keys, copies, strict=True)]).distinct() if keys else found.select(F.lit(1).alias("#hit")).limit(1)), keys

    def flag(self, e) -> Column:
        found, keys = self.existing(e)
        name = self.fresh()
        if self.df is None:
            self.df = self.one()
        if keys:
            self.df = self.attach(keys, found.withColumn(name, F.lit(True)), "left")
        else:
            self.df = self.df.join(found.select(F.lit(True).alias(name)), how="left")
        return F.coalesce(col(name), F.lit(False))

    def pattern_comprehension(self, e, counted: bool = False) -> Column:
        """The sorted list of a pattern's values, or how many there are, for each row."""
        sub, keys = self.outer(e)
        sub.match(e[1], e[2], False)
        name = self.fresh()
        value = sub.expr(e[3])
        if counted:
            found = sub.df.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias(name))
            self.df = self.attach(keys, found, "left")
            return F.coalesce(col(name), F.lit(0)).cast("long")
        found = sub.df.select(*[col(c) for c in keys], value.alias(name))
        kind = found.schema[name].dataType
        listed = F.collect_list(col(name))
        found = found.groupBy(*[col(c) for c in keys]).agg((F.sort_array(listed) if isinstance(kind, T.AtomicType) else listed).alias(name))
        self.df = self.attach(keys, found, "left")
        return F.coalesce(col(name), F.array().cast(f"array<{kind.simpleString()}>"))

    # -- clauses --------------------------------------------------------------------------------

    def filter(self, where) -> None:
        for e in conjuncts(where):
            if has_aggregate(e):
                raise CypherSyntaxError("InvalidAggregation", "in WHERE")
            inner = e[1] if e[0] == "not" else e
            if inner[0] in ("exists", "existsq"):
                found, keys = self.existing(inner)
                if keys:
                    self.df = self.attach(keys, found, "left_anti" if e[0] == "not" else "left_semi")
                    continue
            test = self.boolean(e, {})
            self.df = self.df.where(test)

    def match(self, patterns, where, optional: bool) -> None:
        if optional:
            tree = ("exists", patterns, where)
            sub, keys = self.outer(tree)
            known = set(self.env)
            sub.match(patterns, where, False)
            new = [v for v in sub.env if v not in known]
            extra = [c for v in new for c in sub.columns_of(v)] + [c for c in sub.df.columns if c.endswith("$between")]
            found = sub.df.select(*[col(c) for c in dict.fromkeys([*keys, *extra])])
            self.df = self.attach(keys, found, "left") if self.df is not None else self.one().join(found, how="left")
            self.env.update({v: sub.env[v] for v in new})
            self.names = sub.names
            return
        for _, path, chain in patterns:
            self.chain(path, chain)
        self.filter(where)

    def certain(self, labels: list[str], allowed: set[str] | None) -> bool:
        """Whether nodes with one of the allowed labels need no test for labels."""
        return not labels or (allowed is not None and len(labels) == 1 and allowed <= set(labels))

    def bind_node(self, node, allowed: set[str] | None, on: str | None) -> None:
        """Add a node variable whose id is in the column `on` (None: any node); a bound one only gets its tests."""
        _, var, labels, props = node
        if var in self.env:
            if self.kind(var) != "node":
                raise CypherSyntaxError("VariableTypeConflict", var)
            if on:
                self.df = self.df.where(col(on) == col(f"{var}$id"))
            known = self.env[var][2] if len(self.env[var]) == 3 else None
            if not self.certain(labels, known):
                self.df = self.df.where(self.expr(("haslabels", var, labels)))
        elif on and not props and self.certain(labels, allowed):
            self.df = self.df.withColumn(f"{var}$id", col(on))
            self.env[var] = ("node", ["id"], allowed)
        else:
            some = set(labels[:1]) & (allowed if allowed is not None else set(labels[:1])) if labels else allowed
            table = self.graph.node_table(some)
            if table is None:  # no such label: no rows
                table = self.graph.node_table(None)
                table = table.where(F.lit(False)) if table is not None else self.spark.createDataFrame([], "id long, labels array<string>")
            columns = table.columns
            table = table.select(*[col(c).alias(f"{var}${c}") for c in columns])
            if on:
                self.df = self.df.join(table, col(on) == col(f"{var}$id"))
            else:
                self.df = table if self.df is None else self.df.crossJoin(table)
            self.env[var] = ("node", columns)
            if labels[1:]:
                self.df = self.df.where(self.expr(("haslabels", var, labels[1:])))
        for k, v in props:
            self.df = self.df.where(self.binary("=", ("prop", ("var", var), k), v, {}))

    def oriented(self, types: list[str], direction: str) -> DataFrame:
        """Relationships with `from` and `to`; both ways for undirected ones, self-loops once."""
        table = self.graph.rel_table(types)
        if table is None:
            table = self.graph.rel_table([])
            table = table.where(F.lit(False)) if table is not None else self.spark.createDataFrame([], "id long, start long, end long, type string")
        return self.directed(table, "start", "end", direction)

    @staticmethod
    def directed(table: DataFrame, start: str, end: str, direction: str) -> DataFrame:
        out = table.withColumn("from", col(start)).withColumn("to", col(end))
        back = table.withColumn("from", col(end)).withColumn("to", col(start))
        return out if direction == "out" else back if direction == "in" else out.unionByName(back.where(col(start) != col(end)))

    def chain(self, path: str | None, chain: list) -> None:
        elements, previous = [], []
        bound = next((k for k in range(0, len(chain), 2) if chain[k][1] in self.env), 0)
        if bound:  # start from what is known
            flip = {"out": "in", "in": "out", "both": "both"}
            if bound == len(chain) - 1 and path is None and all(x[0] == "node" or x[1].startswith("#") for x in chain if x[0] == "node" or x[5] is not None):
                chain = [x if x[0] == "node" else (*x[:4], flip[x[4]], x[5]) for x in reversed(chain)]
        first = chain[0]
        starts = self.reach(chain[1], 0) if len(chain) > 1 else None
        step = chain[1] if len(chain) > 1 else None
        known = step is not None and self.kind(step[1]) in ("rel", "relist", "value")
        late = step is not None and first[1] not in self.env and step[5] is None and (known or (self.certain(first[2], starts) and (not first[3] or self.carried(step, first, chain[2])[0] == first[1])))
        if step is not None and step[5] is not None and self.kind(step[1]) in ("relist", "value"):
            self.df = self.df.withColumn("#first", F.get(col(step[1]), F.lit(0))["start" if step[4] != "in" else "end"])
            self.bind_node(first, None, "#first")
        elif not late and not known:
            self.bind_node(first, starts, None)
        elements.append(("node", first[1]))
        for k in range(1, len(chain), 2):
            rel, node = chain[k], chain[k + 1]
            source = chain[k - 1]
            if rel[5] is not None and self.kind(rel[1]) in ("relist", "value"):
                self.bound_list(rel, source[1], node)
                elements.append(("relist", rel[1]))
            elif rel[5] is not None:
                self.variable_length(rel, source[1], node, previous, path)
                elements.append(("relist", rel[1]))
            else:
                self.single_step(rel, source, node, previous)
                elements.append(("rel", rel[1]))
            elements.append(("node", node[1]))
        if path:
            if path in self.env:
                raise CypherSyntaxError("VariableAlreadyBound", path)
            self.env[path] = ("path", elements)

    def reach(self, rel, at: int) -> set[str] | None:
        """Labels possible at the source (0) or target (1) of a step; None: any."""
        a, b = self.graph.endpoint_labels(rel[2], 1), self.graph.endpoint_labels(rel[2], 2)
        if a is None or b is None or (rel[5] is not None and (rel[5][0] == 0 or rel[5][1] != 1)):
            return None
        return a | b if rel[4] == "both" else (a, b)[at] if rel[4] == "out" else (b, a)[at]

    def single_step(self, rel, source, node, previous: list) -> None:
        _, var, types, props, direction, _ = rel
        carrier = None
        if var in self.env:
            if self.kind(var) != "rel":
                raise CypherSyntaxError("VariableTypeConflict", var)
            # a bound relationship: the row holds its ends
            self.df = self.directed(self.df, f"{var}$start", f"{var}$end", direction).withColumnsRenamed({"from": f"{var}$from", "to": f"{var}$to"})
            if types:
                self.df = self.df.where(col(f"{var}$type").isin(types))
            self.bind_node(source, None, f"{var}$from")
        else:
            carrier, table = self.carried(rel, source, node)
            table = self.oriented(types, direction) if table is None else table
            columns = [c for c in table.columns if c not in ("from", "to") and not c.startswith("#n$")]
            held_ = [c.removeprefix("#n$") for c in table.columns if c.startswith("#n$")]
            own = [col(f"#n${c}").alias(f"{carrier}${c}") for c in held_] + ([col("from" if carrier == source[1] else "to").alias(f"{carrier}$id")] if held_ else [])
            table = table.select(*[col(c).alias(f"{var}${c}") for c in columns], col("from").alias(f"{var}$from"), col("to").alias(f"{var}$to"), *own)
            if source[1] in self.env:
                on = col(f"{source[1]}$id") == col(f"{var}$from")
                if node[1] in self.env and self.kind(node[1]) == "node":
                    on = on & (col(f"{node[1]}$id") == col(f"{var}$to"))
                self.df = self.df.join(table, on)
            else:
                self.df = table if self.df is None else self.df.crossJoin(table)
                if node[1] in self.env and node[1] != source[1]:
                    self.df = self.df.where(col(f"{node[1]}$id") == col(f"{var}$to"))
                if carrier != source[1]:
                    self.bind_node(source, self.reach(rel, 0), f"{var}$from")
            if carrier:
                self.env[carrier] = ("node", ["id", *held_])
            self.env[var] = ("rel", columns)
            if carrier == source[1]:
                self.bind_node(source, None, None)
        for k, v in props:
            self.df = self.df.where(self.binary("=", ("prop", ("var", var), k), v, {}))
        for other, kinds, is_list in previous:
            if not types or not kinds or set(types) & set(kinds):
                own = (col(f"{var}$type"), col(f"{var}$id"))
                if is_list:
                    same = F.exists(col(other), lambda x, own=own: (x["type"] == own[0]) & (x["id"] == own[1]))
                else:
                    same = (col(f"{other}$id") == own[1]) & (col(f"{other}$type") == own[0])
                self.df = self.df.where(~same)
        previous.append((var, types, False))
        self.bind_node(node, self.reach(rel, 1), f"{var}$to" if carrier != node[1] else None)
        self.df = self.df.drop(f"{var}$from", f"{var}$to")

    def carried(self, rel, source, node) -> tuple[str | None, DataFrame | None]:
        """The node, new here, whose columns the relationships' own table holds, and that table with `from` and `to`."""
        types, direction = rel[2], rel[4]
        if len(types) != 1 or direction == "both" or types[0] not in self.graph.wide or source[1] == node[1]:
            return None, None
        which, table = self.graph.wide[types[0]]
        at = int((which == "end") == (direction == "out"))
        own = (source, node)[at]
        if own[1] in self.env or not self.certain(own[2], self.reach(rel, at)):
            return None, None
        return own[1], self.directed(table.withColumn("type", F.lit(types[0])), "start", "end", direction)

    def variable_length(self, rel, source: str, node, previous: list, path: str | None) -> None:
        """Unrolled steps that never repeat a relationship; without an upper bound until none can follow."""
        _, var, types, props, direction, (low, high) = rel
        steps = self.oriented(types, direction)
        for k, v in props:
            steps = steps.where(col(k) == self.expr(v)) if k in steps.columns else steps.where(F.lit(False))
        full = "*" in self.asked or var in self.asked or path in self.asked
        own = [c for c in steps.columns if c not in ("from", "to")] if full else ["type", "id", "start", "end"]
        steps = steps.select(F.struct(*[col(c) for c in own]).alias("#rel"), col("type").alias("#type"), col("id").alias("#id"), col("from").alias("#from"), col("to").alias("#to"))
        entities = path is not None and ("*" in self.asked or path in self.asked)
        if entities:
            nodes = self.graph.node_table(None)
            steps = steps.join(nodes.select(F.struct("*").alias("#node"), col("id").alias("#n")), col("#to") == col("#n")).drop("#n")
        else:
            steps = steps.withColumn("#node", col("#to"))
        # levels without a bound are held, so that none is walked again for the next one
        if high is None:
            steps = held(steps)
        between = f"{var}$between"
        seen = [F.transform(col(o), lambda x: F.struct(x["type"].alias("type"), x["id"].alias("id"))) if many else F.array(F.struct(col(f"{o}$type").alias("type"), col(f"{o}$id").alias("id"))) for o, _, many in previous]
        empty = F.array().cast("array<struct<type:string,id:bigint>>")
        rels, nodes = steps.schema["#rel"].dataType.simpleString(), steps.schema["#node"].dataType.simpleString()
        now = self.df.withColumn("#at", col(f"{source}$id")).withColumn("#seen", F.concat(*seen, empty))
        now = now.withColumn(var, F.array().cast(f"array<{rels}>")).withColumn("#nodes", F.array().cast(f"array<{nodes}>"))
        levels = [now] if low == 0 else []
        for level in range(1, high + 1) if high is not None else count(1):
            own = F.struct(col("#type").alias("type"), col("#id").alias("id"))
            now = now.join(steps, (col("#at") == col("#from")) & ~F.array_contains(col("#seen"), own))
            now = now.withColumns({"#at": col("#to"), "#seen": F.array_append(col("#seen"), own), var: F.array_append(col(var), col("#rel")), "#nodes": F.array_append(col("#nodes"), col("#node"))})
            now = now.drop("#rel", "#type", "#id", "#from", "#to", "#node")
            if high is None:
                now = held(now)
                if now.isEmpty():
                    break
            if level >= low:
                levels.append(now)
        if not levels:
            levels = [now.where(F.lit(False))]
        out = reduce(lambda a, b: a.unionByName(b), levels)
        out = out.withColumn(between, F.slice("#nodes", F.lit(1), F.greatest(F.size("#nodes") - 1, F.lit(0)))).drop("#seen", "#nodes")
        self.df = out
        self.env[var] = ("relist",)
        previous.append((var, types, True))
        ends = self.graph.endpoint_labels(types, 1), self.graph.endpoint_labels(types, 2)
        self.bind_node(node, None if low == 0 or None in ends else ends[0] | ends[1], "#at")
        self.df = self.df.drop("#at")

    def bound_list(self, rel, source: str, node) -> None:
        """A list of relationships that is known: its members must follow each other from the source."""
        _, var, types, _, direction, (low, high) = rel
        if direction == "both":
            raise CypherSyntaxError("RequiresDirectedRelationship", var)
        a, b = ("start", "end") if direction == "out" else ("end", "start")
        own = col(var)
        linked = F.forall(F.zip_with(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda x, y: x[b] == y[a]), lambda x: x)
        test = (F.size(own) >= low) & (F.lit(True) if high is None else F.size(own) <= high) & linked & (F.get(own, F.lit(0))[a] == col(f"{source}$id"))
        if types:
            test = test & F.forall(own, lambda x: x["type"].isin(types))
        self.df = self.df.where(test).withColumn("#at", F.get(own, F.size(own) - 1)[b])
        self.bind_node(node, None, "#at")
        self.df = self.df.drop("#at", "#first")

    def unwind(self, e, name: str) -> None:
        if self.df is None:
            self.df = self.one()
        if has_aggregate(e):
            raise CypherSyntaxError("InvalidAggregation", "in UNWIND")
        c, t = self.typed(e, {})
        self.env = {**self.env}
        hold = self.fresh()
        self.df = self.df.withColumn(hold, F.explode(c)) if scalar.is_list(t) else self.df.where(F.lit(False)).withColumn(hold, c)
        if name in self.env:
            self.df = self.df.drop(*self.columns_of(name))
        self.df = self.df.withColumnRenamed(hold, name)
        self.env[name] = ("value",)

    def aggregate(self, e) -> Column:
        _, name, arg, distinct, more = e
        if arg is None:
            return F.count(F.lit(1))
        if has_aggregate(arg):
            raise CypherSyntaxError("NestedAggregation", name)
        if name == "count" and arg[0] == "var" and self.kind(arg[1]) in ("node", "rel", "gone"):
            # a relationship is there where its start is; its own number may be dear to make
            if self.kind(arg[1]) == "rel" and distinct:
                return F.count_distinct(col(f"{arg[1]}$type"), col(f"{arg[1]}$id"))
            x = col(f"{arg[1]}$start" if self.kind(arg[1]) == "rel" else f"{arg[1]}$id")
            return F.count_distinct(x) if distinct else F.count(x)
        x, t = self.typed(arg, {})
        if name == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "sum":
            if not isinstance(t, T.NumericType):  # what is no number counts as 0
                return F.sum(F.lit(0)) if class_of(t) != "duration" else temporal.duration(*[F.coalesce(F.sum(x[f]), F.lit(0)) for f in ("months", "days", "seconds", "nanos")])
            return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0))
        if name == "avg":
            return F.call_function("avg", x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
        if name in ("min", "max"):
            if temporal.kind_of(t) in ("datetime", "time", "localtime", "duration"):
                return (F.min_by if name == "min" else F.max_by)(x, temporal.sort_key(x, t))
            return F.min(x) if name == "min" else F.max(x)
        if name == "collect":
            return F.array_distinct(F.collect_list(x)) if distinct else F.collect_list(x)
        p = more[0][1] if more and more[0][0] == "lit" else self.params.get(more[0][1]) if more and more[0][0] == "param" else None
        if p is None or not 0 <= p <= 1:
            raise ArgumentError("NumberOutOfRange", f"percentile {more}")
        if name == "percentilecont":
            return F.percentile(x, F.lit(float(p)))
        hold = self.fresh()
        self.df = self.df.withColumn(hold, x)
        return F.expr(f"percentile_disc({float(p)}) WITHIN GROUP (ORDER BY `{hold}`)").cast(t)

    def projection(self, items, star: bool, distinct: bool, order, where) -> None:
        if self.df is None:
            self.df = self.one()
        if star:
            items = [(("var", v), v) for v in self.env if not v.startswith("#")] + items
            if not items:
                raise CypherSyntaxError("NoVariablesInScope", "*")
        if any(has_aggregate(e) for e, _ in items):
            items, order = self.grouped(items, order)
        env, columns, renamed = {}, [], {}
        for e, name in items:
            kind = self.kind(e[1]) if e[0] == "var" else ""
            if kind in ("node", "rel"):
                env[name] = self.env[e[1]]
                columns += [(f"{name}${c}", col(f"{e[1]}${c}")) for c in env[name][1]]
            elif kind == "path":
                env[name] = ("value",)
                columns.append((name, self.entity(e[1])))
            else:
                env[name] = ("relist",) if kind == "relist" else ("value",)
                columns.append((name, self.expr(e)))
                if e[0] != "var":
                    renamed[repr(e)] = name
        # sort keys see both the old variables and the new names
        keys = []
        after = {n: c for n, c in columns}
        for e, up in order:
            if has_aggregate(e):
                raise CypherSyntaxError("InvalidAggregation", "in ORDER BY")
            if e[0] == "var" and e[1] in env:
                c = after.get(e[1], after.get(f"{e[1]}$id"))
            elif repr(e) in renamed:
                c = after[renamed[repr(e)]]
            elif e[0] == "prop" and e[1][0] == "var" and f"{e[1][1]}${e[2]}" in after:
                c = after[f"{e[1][1]}${e[2]}"]
            else:
                c = self.expr(e, {n: (x, x) for n, x in after.items() if n not in self.env})
            t = self.type_of(c)
            keys.append((temporal.sort_key(c, t) if temporal.kind_of(t) else c, up))
        columns += [(c, col(c)) for c in self.carry]
        df = self.df
        if distinct:
            names = {n: c for n, c in columns}
            df = df.select(*[c.alias(n) for n, c in names.items()], *[c.alias(f"#s{k}") for k, (c, _) in enumerate(keys)])
            # an entity is one by its id
            by = [n for n in names if "$" not in n or n.startswith("#o") or n.endswith(("$id", "$type"))]
            df = df.dropDuplicates(by)
            columns = [(n, col(n)) for n in names]
            keys = [(col(f"#s{k}"), up) for k, (_, up) in enumerate(keys)]
        if keys:
            df = df.select(*[c.alias(n) for n, c in columns], *[c.alias(f"#o{k}") for k, (c, _) in enumerate(keys)])
            df = df.orderBy(*[col(f"#o{k}").asc_nulls_last() if up else col(f"#o{k}").desc_nulls_first() for k, (_, up) in enumerate(keys)]).drop(*[f"#o{k}" for k in range(len(keys))])
        else:
            df = df.select(*[c.alias(n) for n, c in columns]) if columns else df
        self.df, self.env = df, env
        if where:
            self.filter(where)

    def grouped(self, items, order):
        """Group by the items without aggregates; aggregates become columns that the items then use."""
        keys, sites = [], {}

        def lift(e):
            if isinstance(e, tuple) and e[:1] == ("agg",):
                return ("column", sites.setdefault(repr(e), (f"#a{len(sites)}", e))[0])
            return type(e)(lift(x) for x in e) if isinstance(e, (tuple, list)) else e

        out, by, kept = [], [(c, col(c)) for c in self.carry], []
        for e, name in items:
            if has_aggregate(e):
                out.append((lift(e), name))
                continue
            if e[0] == "var" and self.kind(e[1]) in ("node", "rel"):
                # an entity groups by its id (and type); its other columns go along
                own = [c for c in self.columns_of(e[1]) if c.endswith(("$id", "$type"))]
                by += [(c, col(c)) for c in own]
                kept += [c for c in self.columns_of(e[1]) if c not in own]
                out.append((e, name))
            else:
                hold = f"#g{len(keys)}"
                keys.append((hold, self.expr(e), e, name))
                by.append((hold, keys[-1][1]))
                out.append((("column", hold), name))
        loose = set()
        for e, _ in items:
            if has_aggregate(e):
                loose |= {(v, p) for v, p in references(lift(e)) if v in self.env}
        plain = {repr(e): hold for hold, _, e, _ in keys}
        for v, p in loose:
            tree = ("prop", ("var", v), p) if p else ("var", v)
            if repr(tree) not in plain and not any(e == ("var", v) for e, _ in items):
                raise CypherSyntaxError("AmbiguousAggregationExpression", v)

        def swap(e):
            if repr(e) in plain:
                return ("column", plain[repr(e)])
            return type(e)(swap(x) for x in e) if isinstance(e, (tuple, list)) else e

        named = {repr(e): n for e, n in items}
        order = [((("var", named[repr(e)]) if repr(e) in named else lift(e)), up) for e, up in order]
        found = [self.aggregate(e).alias(n) for n, e in sites.values()] + [F.first(col(c)).alias(c) for c in dict.fromkeys(kept)]
        by = list(dict(by).items())
        self.df = self.df.groupBy(*[c.alias(n) for n, c in by]).agg(*found) if by else self.df.agg(*found)
        self.env = {v: k for v, k in self.env.items() if all(c in self.df.columns for c in self.columns_of(v)) and self.columns_of(v)}
        return [(swap(e), n) for e, n in out], [(swap(e), up) for e, up in order]

    def constant(self, e) -> int:
        n = e[1] if e[0] == "lit" else self.params.get(e[1]) if e[0] == "param" else None
        if n is None:
            raise CypherSyntaxError("NonConstantExpression", str(e))
        if not isinstance(n, int) or n < 0:
            raise CypherSyntaxError("NegativeIntegerArgument", str(n))
        return n

    def procedure(self, name: str, args, out, alone: bool = False) -> None:
        inputs, table, types = self.graph.procedure(name)
        if args is None:
            if not alone:
                raise CypherSyntaxError("InvalidArgumentPassingMode", name)
            missing = [c for c in inputs if c not in self.params]
            if missing:
                raise ParameterMissing("MissingParameter", str(missing))
            args = [("param", c) for c in inputs]
        if len(args) != len(inputs):
            raise CypherSyntaxError("InvalidNumberOfArguments", name)
        if any(has_aggregate(a) for a in args):
            raise CypherSyntaxError("InvalidAggregation", "in CALL")
        if out == "*" and not alone:
            raise CypherSyntaxError("UnexpectedSyntax", "YIELD * beside other clauses")
        outputs = [(c, c) for c in table.columns if c not in inputs] if out in (None, "*") else out
        unknown = [c for c, _ in outputs if c not in table.columns]
        if unknown:
            raise ProcedureError("UnknownOutput", str(unknown))
        if any(n in self.env for _, n in outputs) or len({n for _, n in outputs}) < len(outputs):
            raise CypherSyntaxError("VariableAlreadyBound", name)
        if self.df is None:
            self.df = self.one()
        given = []
        for k, a in enumerate(args):
            x, t = self.typed(a, {})
            if types:
                wanted, kind = types[k].rstrip("?"), class_of(t)
                whole_number = isinstance(t, scalar.INTEGRAL)
                fits = {"STRING": kind == "string", "INTEGER": kind == "number" and whole_number, "FLOAT": kind == "number", "NUMBER": kind == "number"}[wanted]
                if not fits and not (kind == "null" and types[k].endswith("?")):
                    raise CypherTypeError("InvalidArgumentType", f"{name}: {t.simpleString()} for {types[k]}")
            given.append((self.fresh(), x))
        left = self.df.select("*", *[c.alias(n) for n, c in given])
        table = table.select(*[col(c).alias(f"#p${c}") for c in inputs], *[col(c).alias(n) for c, n in outputs])
        on = [col(n).eqNullSafe(col(f"#p${c}")) for (n, _), c in zip(given, inputs, strict=True)]
        joined = left.join(table, reduce(lambda a, b: a & b, on)) if on else left.crossJoin(table) if outputs else left
        self.df = joined.drop(*[n for n, _ in given], *[f"#p${c}" for c in inputs])
        self.env.update({n: ("value",) for _, n in outputs})

    def clause(self, c) -> None:
        if c[0] == "match":
            self.match(c[1], c[2], c[3])
        elif c[0] == "unwind":
            self.unwind(c[1], c[2])
        elif c[0] in ("with", "return"):
            self.projection(*c[1:])
        elif c[0] == "skip":
            self.df = self.df.offset(self.constant(c[1]))
        elif c[0] == "limit":
            self.df = self.df.limit(self.constant(c[1]))
        elif c[0] in UPDATES:
            self.update(c)

    def run(self, clauses) -> DataFrame:
        """The rows of a query; without RETURN, or a CALL at its end, there are none."""
        returned = False
        for c in clauses:
            if c[0] == "call":
                self.procedure(c[1], c[2], c[3], len(clauses) == 1)
            else:
                self.clause(c)
            returned = c[0] in ("return", "call") or (returned and c[0] in ("skip", "limit"))
        if not returned:
            return (self.df if self.df is not None else self.one()).limit(0).select()
        out = [(v, self.entity(v)) for v in list(self.env) if not v.startswith("#")]
        return self.df.select(*[c.alias(v) for v, c in out], *[col(c) for c in self.carry])


def execute(graph: PropertyGraph, text: str, spark: SparkSession, params: dict | None = None) -> tuple[DataFrame, PropertyGraph]:
    """A query's rows, and the graph after its changes: a new one, the given one stays as it is.

    Nothing runs before an action, but for unbounded paths and changes, which hold the rows they work on.
    """
    tree = parse(text)
    asked = whole(tree)
    if tree[0] == "query":
        plan = Plan(graph, spark, params or {}, asked=asked)
        return plan.run(tree[1]), plan.graph
    parts = []
    for q in tree[1]:
        plan = Plan(graph, spark, params or {}, asked=asked)
        parts.append(plan.run(q[1]))
        graph = plan.graph
    if any(p.columns != parts[0].columns for p in parts):
        raise CypherSyntaxError("DifferentColumnsInUnion", str([p.columns for p in parts]))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return (out if tree[2] else out.distinct()), graph


def cypher(graph: PropertyGraph, text: str, spark: SparkSession, params: dict | None = None) -> DataFrame:
    """The rows of a query; see execute."""
    return execute(graph, text, spark, params)[0]
