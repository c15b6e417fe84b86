"""Which addresses the rules of their hosts allow, and how long to wait between two.

A host's file is parsed to groups of agents and rules by windows over its lines. The group for an agent is chosen once for each host, so addresses meet one row, of the rules that hold for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _decoded(path: Column) -> Column:
    """A path without percent escapes; one that cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def rules(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """``(host, grp, agents, rules, delay)``: the groups of each file in order; ``rules`` are ``(allow, path)`` in order of the file.

    Lines of agents begin a group and rules follow; a blank line ends it. Rules before any agent, agents without rules, comments and other lines count for nothing. A rule without a path allows all.
    Of a group's delays the last one stands that is a whole number.
    """
    lines = files.select(host, F.posexplode(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n")).alias("at", "line"))
    blank = F.col("line") == ""
    text = F.trim(F.regexp_replace("line", "#.*", ""))
    name, value = F.lower(F.trim(F.split_part(text, F.lit(":"), F.lit(1)))), F.trim(F.regexp_extract(text, "^[^:]*:(.*)$", 1))
    kind = F.when(blank, "blank").when(F.instr(text, ":") == 0, None).when(name == "user-agent", "agent").when(name.isin("allow", "disallow", "crawl-delay", "request-rate"), name)
    lines = lines.select(host, "at", kind.alias("kind"), value.alias("value")).where("kind is not null")
    order = Window.partitionBy(host).orderBy("at")
    begins = (F.col("kind") == "agent") & ~F.coalesce(F.lag("kind").over(order) == "agent", F.lit(False))
    lines = lines.withColumn("grp", F.sum(F.when(begins, 1).otherwise(0)).over(order))
    # what stands after a blank line has no agents until new ones come; agents right before it have no rules
    inside = Window.partitionBy(host, "grp").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.where("grp > 0").withColumn("over", F.coalesce(F.max(F.col("kind") == "blank").over(inside), F.lit(False))).where("not over and kind <> 'blank'")
    path = _decoded(F.col("value"))
    rule = F.struct("at", ((F.col("kind") == "allow") | (path == "")).alias("allow"), path.alias("path"))
    groups = lines.groupBy(host, "grp").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "agent", F.struct("at", F.lower("value").alias("a"))))), lambda x: x["a"]).alias("agents"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind").isin("allow", "disallow"), rule))), lambda x: F.struct(x["allow"].alias("allow"), x["path"].alias("path"))).alias("rules"),
        F.max_by(F.col("value").try_cast("int"), F.when((F.col("kind") == "crawl-delay") & F.col("value").rlike("^[0-9]{1,9}$"), F.col("at"))).alias("delay"),
        F.count_if(F.col("kind") != "agent").alias("n"),
    )
    return groups.where("n > 0").drop("n")


def rules_for(groups: DataFrame, agent: str, host: str = "host") -> DataFrame:
    """One group for each host: the first with a name that is part of the agent's, else the first for all, ``*``; a group for all is for no agent before the others."""
    me = agent.split("/")[0].lower()
    rank = F.when(F.array_contains("agents", "*"), 1).when(F.exists("agents", lambda a: F.contains(F.lit(me), a)), 0)
    return groups.withColumn("_r", rank).where("_r is not null").groupBy(host).agg(F.min_by(F.struct("rules", "delay"), F.struct("_r", "grp")).alias("g")).select(host, "g.rules", "g.delay")


def allowed(addresses: DataFrame, files: DataFrame, agent: str, url: str = "url", match: str = "first", delay: int = 3) -> DataFrame:
    """``addresses`` with ``allowed`` and ``crawl_delay``, by the ``files(host, body)`` of their hosts.

    With ``match`` ``first``, the first rule of the group whose path the address begins with decides, a fragment being part of the address; with ``longest``, the longest does, an allowance before a refusal of one length, and ``*`` and a ``$`` at the end
    are patterns. Hosts without a file, a group or a rule that fits allow all; without a delay of its own a host has ``delay``. An address without a host is allowed. A host has one file.
    """
    if match not in ("first", "longest"):
        raise ValueError("match is first or longest")
    # by pattern, as addresses with a space or a stray percent sign have a host too
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), "^[^/?#]*//(?:[^@/?#]*@)?([^/?#:]*)", 1), F.lit("")))
    where = F.regexp_extract(F.col(url), "(?s)^[^/?#]*//[^/?#]*(.*)$", 1)
    if match == "longest":
        where = F.regexp_replace(where, "(?s)#.*$", "")
        where = F.when(F.startswith(where, F.lit("/")), where).otherwise(F.concat(F.lit("/"), where))
    path = _decoded(F.when(where == "", "/").otherwise(where))
    own = rules_for(rules(files.select(F.lower("host").alias("_host"), "body"), "_host"), agent, "_host").select("_host", F.col("rules").alias("_rules"), F.col("delay").alias("_delay"))
    rows = addresses.withColumn("_h", host).withColumn("_path", path).join(own, F.col("_h") == F.col("_host"), "left")
    here = F.col("_path")

    def fits(r: Column) -> Column:
        if match == "first":
            return F.startswith(here, r["path"])
        # a pattern's literal parts are quoted; quotes within them are doubled apart
        quoted = F.concat(F.lit("(?s)^\\Q"), F.replace(F.replace(F.regexp_replace(r["path"], r"\$$", ""), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"), F.when(F.endswith(r["path"], F.lit("$")), "$").otherwise(""))
        return F.when(F.contains(r["path"], F.lit("*")) | F.endswith(r["path"], F.lit("$")), F.rlike(here, quoted)).otherwise(F.startswith(here, r["path"]))

    hits = F.filter(F.col("_rules"), fits)
    if match == "first":
        says = F.get(hits, F.lit(0))["allow"]
    else:
        says = F.element_at(F.array_sort(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow")))), -1)["allow"]
        says = F.when(F.size(hits) > 0, says)
    return rows.withColumn("allowed", F.coalesce(says, F.lit(True))).withColumn("crawl_delay", F.coalesce(F.nullif("_delay", F.lit(0)), F.lit(delay))).drop("_h", "_path", "_host", "_rules", "_delay")
