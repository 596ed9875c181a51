"""evalfold."""
