"""quern: a DataFrame-first engine for curating, selecting, scheduling and scoring training data."""
