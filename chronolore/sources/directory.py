"""The directory of people, merged from three sources in a fixed order: chat users, meeting participants, page authors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolore.functions.ids import person_id, source_key
from chronolore.functions.text import is_blank, normalise_name
from chronolore.lineage import cut
from chronolore.sources import chat, meetings, pages


@dataclass
class Directory:
    """people: person_id, name, email, title, aliases (SYSTEM:value, sorted). aliases: system, value, person_id.
    participants: episode_id, person_id. unattached: page authors whose name several people have."""

    people: DataFrame
    aliases: DataFrame
    participants: DataFrame
    unattached: DataFrame

    def by_email(self, email: str) -> DataFrame:
        return self.people.where(F.lower("email") == email.lower())

    def by_alias(self, system: str, value: str) -> DataFrame:
        return self.aliases.where((F.col("system") == system) & (F.col("value") == value)).join(self.people, "person_id")

    def by_name(self, name: str) -> DataFrame:
        """People of whom a name or an alias is the same."""
        return self._named(lambda n: n == normalise_name(F.lit(name)))

    def by_name_prefix(self, prefix: str) -> DataFrame:
        return self._named(lambda n: F.startswith(n, normalise_name(F.lit(prefix))))

    def participants_of(self, episode_id: str) -> DataFrame:
        return self.participants.where(F.col("episode_id") == episode_id).join(self.people, "person_id")

    def names(self) -> DataFrame:
        """person_id, name: the normalised names and aliases that a person answers to."""
        own = self.people.select("person_id", normalise_name(F.col("name")).alias("name"))
        return own.unionByName(self.aliases.select("person_id", normalise_name(F.col("value")).alias("name"))).where("name <> ''").distinct()

    def _named(self, fits) -> DataFrame:
        return self.people.join(self.names().where(fits(F.col("name"))).select("person_id").distinct(), "person_id", "left_semi")


def same_email(a: Column, b: Column) -> Column:
    return ~is_blank(a) & (F.lower(a) == F.lower(b))


def attach(people: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """names with person_id and n_people: who has exactly the same name. Without anyone a new person's id; with several null."""
    wanted = names.withColumn("_norm", normalise_name(F.col(name)))
    known = people.select(F.col("person_id").alias("_known"), normalise_name(F.col("name")).alias("_norm")).distinct()
    found = known.groupBy("_norm").agg(F.count(F.lit(1)).alias("n_people"), F.min("_known").alias("_known"))
    joined = wanted.join(found, "_norm", "left").withColumn("n_people", F.coalesce("n_people", F.lit(0)))
    own = F.when(F.col("n_people") == 0, person_id(F.lit(None).cast("string"), F.col(name))).when(F.col("n_people") == 1, F.col("_known"))
    return joined.withColumn("person_id", own).drop("_norm", "_known")


def merge(users: DataFrame, participants: DataFrame, authors: DataFrame) -> Directory:
    """users: id, name, real_name, email, display_name, title. participants: episode_id, name, email. authors: author."""
    real = F.coalesce("real_name", "name")
    chatting = users.select(person_id(F.col("email"), real).alias("person_id"), real.alias("name"), "email", "title", F.filter(F.array_distinct(F.array("id", users["name"], real, "display_name")), lambda v: ~is_blank(v)).alias("values"))
    met = participants.join(chatting.where(~is_blank(F.col("email"))).groupBy(F.lower("email").alias("_email")).agg(F.min("person_id").alias("_known")), F.lower(participants["email"]) == F.col("_email"), "left")
    met = met.withColumn("person_id", F.coalesce("_known", person_id(F.col("email"), F.col("name")))).select("episode_id", "person_id", "name", "email")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    new = met.join(chatting, "person_id", "left_anti").groupBy("person_id").agg(F.min("name").alias("name"), F.min("email").alias("email")).withColumn("title", F.lit(None).cast("string"))
    so_far = chatting.groupBy("person_id").agg(first("name"), first("email"), first("title")).unionByName(new)
    wrote = attach(so_far, authors.where(~is_blank(F.col("author"))).select("author").distinct(), "author")
    fresh = wrote.where("n_people = 0").groupBy("person_id").agg(F.min("author").alias("name")).select("person_id", "name", F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("title"))
    everyone = so_far.unionByName(fresh)
    aliases = (
        chatting.select(F.lit("SLACK").alias("system"), F.explode("values").alias("value"), "person_id")
        .unionByName(met.select(F.lit("ZOOM").alias("system"), F.col("name").alias("value"), "person_id"))
        .unionByName(wrote.where("person_id IS NOT NULL").select(F.lit("NOTION").alias("system"), F.col("author").alias("value"), "person_id"))
        .distinct()
    )
    of = aliases.groupBy("person_id").agg(F.array_sort(F.collect_set(F.concat("system", F.lit(":"), "value"))).alias("aliases"))
    people = everyone.join(of, "person_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return Directory(people.select("person_id", "name", "email", "title", "aliases"), aliases, met.select("episode_id", "person_id").distinct(), wrote.where("n_people > 1").select("author", "n_people"))


def read(spark: SparkSession, root: str) -> Directory:
    users = chat.users(spark, root).select("id", "name", "real_name", "profile.email", "profile.display_name", "profile.title")
    met = cut(meetings.metadata(spark, root).select(source_key(F.lit("ZOOM"), F.coalesce("uuid", F.lit(""))).alias("episode_id"), F.explode("participants").alias("p")).select("episode_id", "p.name", "p.email"))
    wrote = cut(pages.files(spark, root).select(F.explode(pages.authors(F.col("value"))).alias("author")).distinct())
    return merge(users, met, wrote)
