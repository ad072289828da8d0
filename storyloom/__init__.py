"""Story analytics as Spark jobs: feeds and articles in, ranked story clusters out."""
