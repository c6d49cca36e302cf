"""L3 reports: buying behaviour, churn, customer behaviour."""
