"""Word lists."""

from __future__ import annotations

import os
import zipfile
from functools import lru_cache
from pathlib import Path

import pyspark

#: Italian stop words and speech words that the frequency reports leave out.
STOP_WORDS = tuple(
    w.lower()
    for w in (
        "e di la il che da in per con su non una si al le i "
        "del della dei delle al ai anche ma come tra fra sia "
        "sono stato stata ha hanno ci quella questo questa queste questi "
        "essere stati perchã quindi giã molto governo piÃ¹ Ã presidente decreto legge solo "
        "sanitÃ Ã¨ pease fare essere avere dire dare collega tema Aula articolo "
        "emendamento chiedere credere oggi regione italia"
    ).split()
)
#: What apostrophes leave behind when they are stripped.
LEFTOVERS = ("l", "d", "c", "all", "dell", "nell", "sull", "coll")
#: Health words that are removed together with the most common words.
DOMAIN_WORDS = tuple(
    (
        "salute sanità ospedale ospedali medico medici paziente pazienti "
        "infermiere infermieri malattia malattie virus vaccino vaccini "
        "covid pandemia pandemie epidemia epidemie infezione infezioni "
        "contagio contagi cura cure malato malati sanitario sanitari "
        "pubblico pubblica sistema emergenza ospedaliero ospedaliere mascherina mascherine "
        "terapia terapie ricovero ricoveri prevenzione vaccinazione vaccinazioni"
    ).split()
)
#: Beginnings of words, without accents, by which a topic counts as a health topic.
HEALTH_PREFIXES = tuple(
    (
        "salute sanita ospedal medic infermier "
        "vaccin pandem epidemi malattia pazient terapia farmac "
        "ssn asl sanitari prevenzion diagnosi ricover "
        "prenotazion sanitaria covid tumor oncolog psichiatr psicolog "
        "obesita materni nascit servizio sanitario_nazionale green_pass virus"
    ).split()
)


@lru_cache(16)
def listed(language: str) -> tuple[str, ...]:
    """Spark's own stop words of a language, as they lie in its jar; needs no session."""
    for home in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)):
        for jar in sorted(Path(home or "/nowhere").glob("jars/spark-mllib_*.jar")):
            with zipfile.ZipFile(jar) as z:
                return tuple(z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split())
    raise FileNotFoundError("no jars of Spark with its lists of stop words")


#: Fixed value: the text that topics are compared with.
HEALTH_QUERY = "sanità salute ospedale medico paziente medicina vaccino epidemia prevenzione diagnosi terapia servizio sanitario nazionale pandemia malattia farmaco ricovero tumore virus"


def italian_stop_words() -> list[str]:
    """Spark's Italian list with the fixed ones and the leftovers."""
    return sorted({*listed("italian"), *STOP_WORDS, *LEFTOVERS})
