"""engramlake: Spark jobs that search, link, group and maintain a corpus of text memories."""
