"""Operations for preparing training data."""
