"""Operations of a training-data pipeline; nothing else in pactlake imports this subpackage."""
