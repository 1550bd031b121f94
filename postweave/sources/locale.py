"""Interface words by language: a small table and its lookup."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words by language; English is complete and what others fall back to.
WORDS = {
    "en": {"Author": "Author", "Subject": "Subject", "Date": "Date", "Thread": "Thread", "Attachment": "Attachment", "Generated by": "Generated by", "Next": "Next", "Previous": "Previous", "Reply": "Reply", "Messages": "Messages"},
    "de": {"Author": "Autor", "Subject": "Betreff", "Date": "Datum", "Thread": "Diskussion", "Attachment": "Anhang", "Generated by": "Erzeugt von", "Next": "Weiter", "Previous": "Zurück", "Reply": "Antwort", "Messages": "Nachrichten",
           "Mon": "Mo", "Tue": "Di", "Wed": "Mi", "Thu": "Do", "Fri": "Fr", "Sat": "Sa", "Sun": "So", "Mar": "Mär", "May": "Mai", "Oct": "Okt", "Dec": "Dez"},
    "fr": {"Author": "Auteur", "Subject": "Sujet", "Date": "Date", "Thread": "Fil", "Attachment": "Pièce jointe", "Generated by": "Généré par", "Next": "Suivant", "Previous": "Précédent", "Reply": "Réponse", "Messages": "Messages",
           "Mon": "lun", "Tue": "mar", "Wed": "mer", "Thu": "jeu", "Fri": "ven", "Sat": "sam", "Sun": "dim",
           "Jan": "jan", "Feb": "fév", "Mar": "mar", "Apr": "avr", "May": "mai", "Jun": "juin", "Jul": "juil", "Aug": "août", "Sep": "sep", "Oct": "oct", "Nov": "nov", "Dec": "déc"},
    "es": {"Author": "Autor", "Subject": "Asunto", "Date": "Fecha", "Thread": "Hilo", "Attachment": "Adjunto", "Generated by": "Generado por", "Next": "Siguiente", "Previous": "Anterior", "Reply": "Respuesta", "Messages": "Mensajes",
           "Mon": "lun", "Tue": "mar", "Wed": "mié", "Thu": "jue", "Fri": "vie", "Sat": "sáb", "Sun": "dom",
           "Jan": "ene", "Feb": "feb", "Mar": "mar", "Apr": "abr", "May": "may", "Jun": "jun", "Jul": "jul", "Aug": "ago", "Sep": "sep", "Oct": "oct", "Nov": "nov", "Dec": "dic"},
}
ALIASES = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "francais": "fr", "spanish": "es"}


def load_words(spark: SparkSession, path: str) -> None:
    """Adds words from a table of the user's: files of `lang<TAB>key<TAB>value` lines, in any store that
    Spark reads. Its languages become known; its words win over those above. Languages are few and
    their words a page each, so that the table is held by the driver."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("lang string, key string, value string").csv(path)
    for r in rows.filter("lang IS NOT NULL AND key IS NOT NULL AND value IS NOT NULL").collect():
        WORDS.setdefault(r["lang"].strip().lower().replace("_", "-"), {})[r["key"]] = r["value"]


def known_languages() -> list[str]:
    return sorted(WORDS)


def resolve(language: str) -> str:
    """Alias, then the exact tag, then its base, then English."""
    tag = language.strip().lower().replace("_", "-")
    tag = ALIASES.get(tag, tag)
    return next((x for x in (tag, re.split("[.@]", tag)[0], re.split("[-.@]", tag)[0]) if x in WORDS), "en")


def word(language: str, key: str) -> str:
    own = resolve(language or "en")
    return WORDS[own].get(key, WORDS.get(re.split("[-.@]", own)[0], {}).get(key, WORDS["en"].get(key, key)))


def words_of(language: str) -> dict[str, str]:
    return WORDS["en"] | WORDS[resolve(language)]


def locale_table(spark: SparkSession) -> DataFrame:
    """lang, key, value: a constant of this module, small enough to broadcast."""
    return spark.createDataFrame([(lang, k, v) for lang, own in WORDS.items() for k, v in own.items()], "lang string, key string, value string")


def localized(rows: DataFrame, table: DataFrame, key: str = "key", language: str = "lang") -> DataFrame:
    """Adds value: the language's word, else English, else the key."""
    own = F.broadcast(table.select(F.col("lang").alias("_l"), F.col("key").alias("_k"), F.col("value").alias("_own")))
    english = F.broadcast(table.filter("lang = 'en'").select(F.col("key").alias("_ek"), F.col("value").alias("_en")))
    tag = F.regexp_extract(F.lower(F.col(language)), "^[a-z]+", 0)
    found = rows.join(own, (tag == F.col("_l")) & (F.col(key) == F.col("_k")), "left").join(english, F.col(key) == F.col("_ek"), "left")
    return found.withColumn("value", F.coalesce("_own", "_en", F.col(key))).drop("_l", "_k", "_own", "_ek", "_en")
