"""Changes to a graph: each clause holds the rows it works on and leaves the plan with a new graph.

Rows are held in the shared folder with a number, so that what is created gets the same ids however often
it is read. Where several rows set one property, the row of greatest number decides. Bound variables
are brought up to date, so that later clauses see the new values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherSyntaxError, CypherTypeError, EntityNotFound, UpdateError
from ..sources.held import held

ROW = "#row"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


class Updates:
    """The updating clauses of a plan."""

    def update(self, clause) -> None:
        if self.df is None:
            self.df = self.one()
        if clause[0] == "create":
            self.number_rows()
            self.create(clause[1])
        elif clause[0] == "merge":
            self.merge(*clause[1:])
        elif clause[0] in ("set", "remove"):
            for item in clause[1]:
                self.number_rows()
                self.assign(item, clause[0] == "set")
        else:
            self.delete(clause[1], clause[2])

    def number_rows(self) -> None:
        df = self.df.drop(ROW) if ROW in self.df.columns else self.df
        self.df = held(df.withColumn(ROW, F.monotonically_increasing_id()))

    # -- create ---------------------------------------------------------------------------------

    def check_created(self, patterns, word: str) -> None:
        made = set(self.env)
        for _, path, chain in patterns:
            if path in made:
                raise CypherSyntaxError("VariableAlreadyBound", path)
            for x in chain:
                if x[0] == "node":
                    if x[1] in made and (x[2] or x[3] or len(chain) == 1):
                        raise CypherSyntaxError("VariableAlreadyBound", x[1])
                elif x[5] is not None:
                    raise CypherSyntaxError("CreatingVarLength", x[1])
                elif len(x[2]) != 1:
                    raise CypherSyntaxError("NoSingleRelationshipType", x[1])
                elif x[4] == "both" and word == "CREATE":
                    raise CypherSyntaxError("RequiresDirectedRelationship", x[1])
                elif x[1] in made:
                    raise CypherSyntaxError("VariableAlreadyBound", x[1])
                made.add(x[1])

    def create(self, patterns) -> None:
        """New nodes and relationships for each row; ids stand above all others, by row and place in the clause."""
        self.check_created(patterns, "CREATE")
        base = self.graph.greatest_id() + 1
        elements = [x for _, _, chain in patterns for x in chain]
        made = [x[1] for x in elements if x[0] == "rel" or x[1] not in self.env]
        ids = {v: F.lit(base) + col(ROW) * len(set(made)) + k for k, v in enumerate(dict.fromkeys(made))}
        new = []
        for _, path, chain in patterns:
            for x in chain:
                if x[0] == "node" and x[1] not in self.env:
                    self.new_columns(x[1], ids[x[1]], x[3], {"labels": F.array(*[F.lit(y) for y in x[2]]).cast("array<string>")})
                    self.env[x[1]] = ("node", ["id", *[k for k, _ in x[3]], "labels"])
                    new.append(x)
            for k in range(1, len(chain), 2):
                rel, ends = chain[k], (chain[k - 1][1], chain[k + 1][1])
                start, end = reversed(ends) if rel[4] == "in" else ends
                self.new_columns(rel[1], ids[rel[1]], rel[3], {"type": F.lit(rel[2][0]), "start": col(f"{start}$id"), "end": col(f"{end}$id")})
                self.env[rel[1]] = ("rel", ["id", *[p for p, _ in rel[3]], "type", "start", "end"])
                new.append(rel)
            if path:
                self.env[path] = ("path", [(x[0], x[1]) for x in chain])
        self.df = held(self.df)
        for x in new:
            own = self.df.select(*[col(f"{x[1]}${c}").alias(c) for c in self.env[x[1]][1] if c not in ("labels", "type")])
            if x[0] == "node":
                self.graph = self.graph.with_nodes(x[2], own)
            else:
                self.graph = self.graph.with_rels(x[2][0], own.where("start is not null and end is not null"), (None, None))

    def new_columns(self, var: str, ident: Column, props, more: dict[str, Column]) -> None:
        for k, e in props:
            x, t = self.typed(e, {})
            if isinstance(t, (T.StructType, T.MapType)) and not self.storable(t):
                raise CypherTypeError("InvalidPropertyType", k)
            self.df = self.df.withColumn(f"{var}${k}", x.cast("string") if isinstance(t, T.NullType) else x)
        self.df = self.df.withColumns({f"{var}$id": ident.cast("long"), **{f"{var}${k}": c for k, c in more.items()}})

    @staticmethod
    def storable(t: T.StructType) -> bool:
        from ..functions.temporal import kind_of

        return kind_of(t) is not None

    # -- merge ----------------------------------------------------------------------------------

    def merge(self, pattern, on_create, on_match) -> None:
        """For each row the pattern's matches, or one that is created; rows whose patterns are equal share what is created."""
        _, path, chain = pattern
        self.check_created([pattern], "MERGE")
        self.number_rows()
        keys = [f"{x[1]}$id" for x in chain if x[0] == "node" and x[1] in self.env]
        held_props, marked = {}, []
        for x in chain:
            own = []
            for k, e in x[3]:
                name = f"#m{len(held_props)}"
                value, t = self.typed(e, {})
                if isinstance(t, T.NullType):
                    raise UpdateError("MergeReadOwnWrites", f"{k} is null")
                held_props[name] = value
                own.append((k, ("column", name)))
            marked.append((*x[:3], own, *x[4:]) if x[0] == "rel" else (*x[:3], own))
        self.df = self.df.withColumns(held_props)
        if held_props and not self.df.where(reduce(lambda a, b: a | b, [col(n).isNull() for n in held_props])).isEmpty():
            raise UpdateError("MergeReadOwnWrites", "a property is null")
        before, env = self.df, dict(self.env)
        self.chain(path, marked)
        for v in [v for v in self.env if v not in env]:
            self.complete(v)
        matched, matched_env = held(self.df.drop(*held_props)), dict(self.env)
        rest = before.join(matched.select(ROW).distinct(), ROW, "left_anti")
        # one row for each distinct pattern creates it
        by = [*keys, *held_props]
        each = rest.select(*[col(c) for c in by]).distinct() if by else rest.select(F.lit(0).alias("#unit")).limit(1)
        maker = self.fork(held(each.withColumn(ROW, F.monotonically_increasing_id())), {v: ("node", ["id"], None) for v, k in env.items() if k[0] == "node" and f"{v}$id" in keys})
        maker.create([("chain", path, [(*x[:4], "out" if x[4] == "both" else x[4], x[5]) if x[0] == "rel" else x for x in marked])])
        self.graph = maker.graph
        fresh = [v for v in maker.env if v not in env]
        columns = [c for v in fresh for c in maker.columns_of(v)]
        made = maker.df.select(*[col(c).alias(f"{c}#k") for c in by], *[col(c) for c in columns])
        on = reduce(lambda a, b: a & b, [col(c).eqNullSafe(col(f"{c}#k")) for c in by]) if by else F.lit(True)
        created = rest.join(made, on).drop(*[f"{c}#k" for c in by], *held_props)
        self.env = {**env, **{v: maker.env[v] if k[0] != "path" else k for v, k in matched_env.items() if v not in env}}
        both = []
        for df, own, mark in ((matched, matched_env, False), (created, maker.env, True)):
            both.append((df.withColumn("#created", F.lit(mark)), own))
        for v in fresh:
            if self.kind(v) in ("node", "rel"):
                held_ = list(dict.fromkeys([*matched_env[v][1], *maker.env[v][1]]))
                self.env[v] = (self.kind(v), held_)
        from ..sources.graph import aligned

        out = held(aligned(both[0][0], both[1][0]).drop(ROW))
        self.df = out
        for items, mark in ((on_create, True), (on_match, False)):
            for item in items:
                self.number_rows()
                self.assign(item, True, only=col("#created") == mark)
        self.df = self.df.drop("#created")

    # -- set, remove ----------------------------------------------------------------------------

    def target(self, var: str) -> str:
        if var not in self.env:
            raise CypherSyntaxError("UndefinedVariable", var)
        if self.kind(var) == "gone":
            raise EntityNotFound("DeletedEntityAccess", var)
        if self.kind(var) not in ("node", "rel"):
            raise CypherTypeError("InvalidArgumentType", f"{var} is no entity")
        return self.kind(var)

    def found(self, var: str, value: Column | None, only: Column | None) -> DataFrame:
        """(uid, value, and utype of relationships): what the last row of each entity says; rows without the entity say nothing."""
        kind = self.target(var)
        rows = self.df.where(col(f"{var}$id").isNotNull()) if only is None else self.df.where(col(f"{var}$id").isNotNull() & only)
        by = [col(f"{var}$id").alias("uid")] + ([col(f"{var}$type").alias("utype")] if kind == "rel" else [])
        last = F.max_by(value if value is not None else F.lit(None).cast("string"), col(ROW)).alias("value")
        return held(rows.groupBy(*by).agg(last))

    def assign(self, item, add: bool, only: Column | None = None) -> None:
        kind = self.target(item[1])
        var = item[1]
        if item[0] == "labels":
            if kind != "node":
                raise CypherTypeError("InvalidArgumentType", "labels of a relationship")
            found = self.found(var, None, only)
            self.graph = self.graph.relabelled(found, item[2], add)
            own = F.array(*[F.lit(x) for x in item[2]])
            self.refresh("node", found, "labels", lambda old, _: F.array_union(old, own) if add else F.array_except(old, own))
            return
        if item[0] == "all":
            self.assign_all(var, item[2], item[3], only)
            return
        _, _, key, how, e = item
        if how == "+=":
            e = ("bin", "+", ("prop", ("var", var), key), e)
        value, t = self.typed(e, {})
        if isinstance(t, (T.StructType, T.MapType)) and not self.storable(t):
            raise CypherTypeError("InvalidPropertyType", key)
        self.put(var, key, self.no_value(var, key) if isinstance(t, T.NullType) else value, only)

    def no_value(self, var: str, key: str) -> Column:
        """Null of the type that the property has."""
        if self.kind(var) == "node":
            self.complete(var)
        name = f"{var}${key}"
        return F.lit(None).cast(self.df.schema[name].dataType if name in self.df.columns else "string")

    def put(self, var: str, key: str, value: Column, only: Column | None) -> None:
        kind = self.target(var)
        found = self.found(var, value, only)
        tables = self.env[var][2] if kind == "node" and len(self.env[var]) == 3 else None
        self.graph = self.graph.assigned(kind, found, key, tables)
        self.refresh(kind, found, key, lambda _, new: new)

    def assign_all(self, var: str, how: str, e, only: Column | None) -> None:
        """n = map or entity: all properties; n += map: those that the map names."""
        self.complete(var) if self.kind(var) == "node" else None
        if e[0] == "map":
            given = {k: x for k, x in e[1]}
        elif e[0] == "param" and isinstance(self.params.get(e[1]), dict):
            given = {k: ("lit", x) for k, x in self.params[e[1]].items()}
        elif e[0] == "var" and self.kind(e[1]) in ("node", "rel"):
            self.complete(e[1])
            given = {c: ("prop", e, c) for c in self.env[e[1]][1] if c not in ("id", "labels", "start", "end", "type")}
        else:
            raise CypherTypeError("InvalidArgumentType", "a map or an entity is needed")
        if how == "=":
            given = {c: ("lit", None) for c in self.env[var][1] if c not in ("id", "labels", "start", "end") and not (c == "type" and self.kind(var) == "rel")} | given
        # values are taken before any of them is put
        values = {}
        for k, x in given.items():
            value, t = self.typed(x, {})
            values[k] = (f"#v{len(values)}", self.no_value(var, k) if isinstance(t, T.NullType) else value)
        self.df = held(self.df.withColumns({n: c for n, c in values.values()}))
        for k, (n, _) in values.items():
            self.put(var, k, col(n), only)
        self.df = self.df.drop(*[n for n, _ in values.values()])

    def refresh(self, kind: str, found: DataFrame, key: str, change) -> None:
        """Bring every variable of the kind up to date whose entities were found."""
        for v in [v for v, k in self.env.items() if k[0] == kind and len(k) == 2]:
            name = f"{v}${key}"
            on = col(f"{v}$id") == col("uid")
            if kind == "rel":
                on = on & (col(f"{v}$type") == col("utype"))
            both = self.df.join(found.withColumnRenamed("value", "#value"), on, "left")
            new, hit = col("#value"), col("uid").isNotNull()
            if name in self.df.columns:
                own, t = self.df.schema[name].dataType, found.schema["value"].dataType
                wide = own if own == t or key == "labels" else T.DoubleType() if isinstance(own, T.NumericType) and isinstance(t, T.NumericType) else T.StringType()
                old = col(name).cast(wide)
                new = new if key == "labels" else new.cast(wide)
            else:
                old = F.lit(None).cast(found.schema["value"].dataType)
                self.env[v] = (kind, [*self.env[v][1], key])
            self.df = both.withColumn(name, F.when(hit, change(old, new)).otherwise(old)).drop("uid", "utype", "#value")

    # -- delete ---------------------------------------------------------------------------------

    def delete(self, detach: bool, items) -> None:
        """Remove what the expressions name; a node goes only without relationships, or with DETACH together with them."""
        nodes, rels, gone = [], [], []
        self.df = held(self.df)
        for e in items:
            if e[0] != "var" or e[1] not in self.env:
                raise CypherSyntaxError("InvalidArgumentType" if e[0] != "var" else "UndefinedVariable", str(e))
            kind = self.kind(e[1])
            if kind == "path":
                detach = True
                parts = [v for _, v in self.env[e[1]][1]]
            elif kind in ("node", "rel", "relist"):
                parts = [e[1]]
            else:
                raise CypherTypeError("InvalidArgumentType", f"DELETE of {e[1]}")
            for v in parts:
                if self.kind(v) == "node":
                    nodes.append(self.df.select(col(f"{v}$id").alias("uid")))
                elif self.kind(v) == "rel":
                    rels.append(self.df.select(col(f"{v}$type").alias("utype"), col(f"{v}$id").alias("uid")))
                elif self.kind(v) == "relist":
                    rels.append(self.df.select(F.explode(col(v)).alias("r")).select(F.col("r.type").alias("utype"), F.col("r.id").alias("uid")))
                gone.append(v)
        if rels:
            self.graph = self.graph.without_rels(held(reduce(DataFrame.union, rels).where("uid is not null").distinct()))
        if nodes:
            ids = held(reduce(DataFrame.union, nodes).where("uid is not null").distinct())
            incident = self.graph.incident(ids)
            if detach:
                self.graph = self.graph.without_rels(held(incident))
            elif not incident.isEmpty():
                raise UpdateError("DeleteConnectedNode", "a node still has relationships")
            self.graph = self.graph.without_nodes(ids)
        for v in gone:
            if self.kind(v) in ("node", "rel"):
                self.env[v] = ("gone", ["id"] if self.kind(v) == "node" else ["id", "type", "start"])
