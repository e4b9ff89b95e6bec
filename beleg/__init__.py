"""Evidence engine on Spark: passages, charts, catalogue links and a document knowledge graph.

Every public function takes DataFrames and returns DataFrames (or writes / streams them);
nothing here collects a data-sized result to the driver.
"""
