"""A corpus made for judging retrieval: files of known topics, queries with known answers, and the quality of an embedder on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval as R
from .service import Embedder

#: Topics with sentences about them, and queries that share few words with those.
TOPICS = {
    "bread": (("The dough rests overnight before it goes into a hot oven.", "Flour, water, salt and yeast are all that a simple loaf needs.", "Kneading builds the strands that hold the crumb together.", "A crisp crust forms when steam meets the baking stone."), ("how do I bake a loaf", "why does dough rise")),
    "tides": (("Twice a day the sea climbs the beach and falls back again.", "The pull of the moon lifts the water on either side of the globe.", "Harbour masters print tables of high and low water.", "Spring tides follow the new moon and the full moon."), ("what makes the sea rise and fall", "when is low water")),
    "bicycle": (("A dry chain squeaks until it gets a drop of oil.", "The rear derailleur moves the chain from cog to cog.", "Check the tyre pressure before every long ride.", "Worn brake pads scrape the rim on wet descents."), ("my bike brakes are noisy", "how to mend a flat tyre")),
    "beekeeping": (("The queen lays eggs in the cells of the lower frames.", "Smoke calms the hive while the keeper lifts the lid.", "Workers fan their wings to dry nectar into honey.", "A swarm hangs from a branch until scouts find a new home."), ("how is honey made", "what does the queen bee do")),
    "telescope": (("A larger mirror gathers more light from faint galaxies.", "Grind the glass until its curve is true to a wavelength.", "The mount turns against the spin of the earth.", "Cool night air keeps the image of the planet still."), ("which lens shows saturn best", "how to look at the stars")),
    "chess": (("Castle early so that the king is safe behind his pawns.", "A knight on the rim controls half as many squares.", "The endgame rewards the player whose king is active.", "She gave up a rook to open the file for her queen."), ("how should I open a game", "when to trade pieces on the board")),
    "compost": (("Turn the heap so that air reaches the middle.", "Kitchen peelings and dry leaves rot down in layers.", "Red worms eat through a bin of scraps in a few weeks.", "Finished humus is dark, crumbly and smells of the woods."), ("what to do with garden waste", "feeding the soil naturally")),
    "railway": (("The signal drops and the express leaves the platform.", "Sleepers spread the weight of the rails over the ballast.", "A banking engine pushes freight up the long gradient.", "Points are heated so that snow can not jam them."), ("how do trains change tracks", "why is my train late")),
    "violin": (("Rosin on the bow makes the string catch and sing.", "The sound post stands under the bridge inside the body.", "Tune the A first and take the fifths from there.", "Spruce for the top and maple for the back."), ("learning to play a string instrument", "what wood are fiddles made of")),
    "volcano": (("Ash falls on the villages below the crater.", "Runny lava travels far, thick lava builds a dome.", "Tremors under the cone warn of rising magma.", "Hot springs steam along the old fault."), ("why do mountains erupt", "signs of an eruption")),
    "printing": (("The compositor sets type letter by letter in a stick.", "Ink is rolled over the raised face of the forme.", "Each sheet is pressed once for every colour.", "Proofs are read aloud against the manuscript."), ("how were books made by hand", "what is movable type")),
    "glacier": (("Snow packs into ice that creeps down the valley.", "Meltwater carves blue tunnels beneath the tongue.", "Boulders left behind mark where the ice once ended.", "Crevasses open where the bed drops steeply."), ("how does ice shape a valley", "why is the ice melting")),
}
FILLERS = "note page item list draft copy part plain later often again small report entry table index simple common second usual".split()
SENTENCES, FILLED = 2, 12


def _at(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def topic_corpus(ids: DataFrame) -> DataFrame:
    """(path, topic, text), a file for each of (id): topics in turn, each round with the next two sentences and twelve more filler words."""
    topics = list(TOPICS)
    rows = ids.select(F.col("id").alias("i"), (F.col("id") % len(topics)).alias("t"), F.floor(F.col("id") / len(topics)).alias("round"))
    variants = [s for t in topics for s in TOPICS[t][0]]
    per = len(TOPICS[topics[0]][0])
    sentences = [_at(variants, F.col("t") * per + (F.col("round") * SENTENCES + k) % per) for k in range(SENTENCES)]
    words = [_at(FILLERS, F.col("i") * FILLED + k) for k in range(FILLED)]
    topic = _at(topics, F.col("t"))
    return rows.select(F.format_string("%s-%04d.txt", topic, "round").alias("path"), topic.alias("topic"), F.concat_ws(" ", *sentences, *words).alias("text"))


def topic_queries(spark: SparkSession) -> DataFrame:
    """(query_id, query, topic)."""
    rows = [(q, t) for t, (_, queries) in TOPICS.items() for q in queries]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id long, query string, topic string")


def retrieval_quality(files: DataFrame, queries: DataFrame, embedder: Embedder, k: int = 10) -> DataFrame:
    """(query_id, hit_1, rr, ap, ndcg, recall) of an embedder over files (path, topic, text), whose relevant ones are those of a query's topic."""
    vectors = files.select(F.col("path").alias("id"), embedder.embed(F.col("text")).alias("vector"))
    asked = queries.select("query_id", embedder.embed(F.col("query"), query=True).alias("vector"))
    hits = R.knn(vectors, asked, k, min_score=-1.0).join(files.select(F.col("path").alias("id"), "topic"), "id")
    ranked = hits.join(queries.select("query_id", F.col("topic").alias("wanted")), "query_id").withColumn("is_relevant", F.col("topic") == F.col("wanted"))
    sizes = files.groupBy("topic").agg(F.count("*").alias("n_relevant"))
    return R.quality(ranked, queries.join(sizes, "topic").select("query_id", "n_relevant"), k)
