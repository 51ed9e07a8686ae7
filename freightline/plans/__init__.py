"""Multi-step jobs: scaling, forecasting, disruption and supplier models, carbon, network, ledger."""
