"""Schemas of sources, and the lists of values that they are filtered by."""

from __future__ import annotations

KLINES = (
    "symbol string, open_time timestamp, open double, high double, low double, close double, volume double, close_time timestamp, "
    "quote_volume double, num_trades long, taker_base_vol double, taker_quote_vol double, ignore string"
)
PRICES = "coin_id string, timestamp timestamp, price double, market_cap double, volume double"
LISTING = "id string, symbol string, name string, market_cap double"

# Pairs of stable coins that universes leave out.
STABLE_PAIRS = [
    "USDCUSDT", "BUSDUSDT", "DAIUSDT", "TUSDUSDT", "USDPUSDT", "GUSDUSDT", "FDUSDT", "PYUSDUSDT", "LUSDUSDT",
    "USDSUSDT", "SUSDUSDT", "CUSDUSDT", "USDXUSDT", "FRAXUSDT", "USDDUSDT", "FDUSDUSDT", "PAXUSDT", "USDSBUSDT",
]
# Tickers of stable coins that listings leave out.
STABLE_TICKERS = ["usdt", "usdc", "busd", "dai", "tusd", "usdp", "frax", "usdd", "gusd"]
# The price API's ids of exchange symbols.
COIN_IDS = {
    "BTCUSDT": "bitcoin",
    "ETHUSDT": "ethereum",
    "BNBUSDT": "binancecoin",
    "XRPUSDT": "ripple",
    "ADAUSDT": "cardano",
    "SOLUSDT": "solana",
    "DOTUSDT": "polkadot",
    "DOGEUSDT": "dogecoin",
    "AVAXUSDT": "avalanche-2",
    "SHIBUSDT": "shiba-inu",
    "MATICUSDT": "matic-network",
    "LTCUSDT": "litecoin",
    "LINKUSDT": "chainlink",
    "ATOMUSDT": "cosmos",
    "UNIUSDT": "uniswap",
    "ETCUSDT": "ethereum-classic",
    "XLMUSDT": "stellar",
    "NEARUSDT": "near",
    "ALGOUSDT": "algorand",
    "VETUSDT": "vechain",
    "ICPUSDT": "internet-computer",
    "FILUSDT": "filecoin",
    "TRXUSDT": "tron",
    "AAVEUSDT": "aave",
    "EOSUSDT": "eos",
    "XTZUSDT": "tezos",
    "THETAUSDT": "theta-token",
    "AXSUSDT": "axie-infinity",
    "SANDUSDT": "the-sandbox",
    "MANAUSDT": "decentraland",
    "FTMUSDT": "fantom",
    "RUNEUSDT": "thorchain",
    "ZILUSDT": "zilliqa",
    "ENJUSDT": "enjincoin",
    "CHZUSDT": "chiliz",
    "BATUSDT": "basic-attention-token",
    "ZECUSDT": "zcash",
    "DASHUSDT": "dash",
    "NEOUSDT": "neo",
    "WAVESUSDT": "waves",
    "QTUMUSDT": "qtum",
    "ONTUSDT": "ontology",
    "IOTAUSDT": "iota",
    "ICXUSDT": "icon",
    "NULSUSDT": "nuls",
}
