from dataclasses import dataclass, field


@dataclass
class Product:
    sku: str
    price: float


@dataclass
class OrderItem:
    product: Product
    quantity: int


@dataclass
class Order:
    order_id: str
    items: list = field(default_factory=list)
    confirmed: bool = False

    def confirm(self):
        self.confirmed = True
