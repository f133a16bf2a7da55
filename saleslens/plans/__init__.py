"""Query registry, oracle SQL, end-to-end pipeline and plan inspection."""
