"""Operations of a training-data pipeline, each over whole tables and whole texts."""
