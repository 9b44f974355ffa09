"""weftline: multilingual text, link graphs and embedding vectors as Spark plans."""
